import io
import time
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, chunking, evaluation, lexical, library, models, ranking, store, vectors
from docloom.plans import retrieval
from docloom.sources import files


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_cleaning_rules(spark):
    assert one(spark, T.clean(F.col("t")), t="A\r\nPage 3 of 9\n2023 2024\n\n\n\nx\u00a0y\u200bz  \nIntro ........ 4") == "A\n\n2023 2024\n\nx yz\nIntro ... 4"
    assert one(spark, T.clean(F.col("t")), t="") == ""
    assert one(spark, T.join_wrapped_lines(F.col("t")), t="exam-\nple of a line\nthat goes on.\nNext") == "example of a line that goes on.\nNext"


def test_tokens_and_stems(spark):
    assert one(spark, T.tokens(F.col("t")), t="The Risks, policies and a 7 b's status")[:2] == ["risk", "policy"]
    assert one(spark, T.tokens(F.col("t")), t="policies status risks 7 x") == ["policy", "status", "risk", "7"]
    assert one(spark, T.coverage(T.tokens(F.lit("risk policies")), T.tokens(F.lit("policy")))) == 0.5


def test_span_coverage_counts_word_runs(spark):
    assert one(spark, T.span_coverage(F.lit("a b c d e f"), F.lit("x A  b c d E y"))) == pytest.approx(0.75)
    assert one(spark, T.span_coverage(F.lit("a b"), F.lit("zz"))) == 0.0


def test_bm25_and_empty_corpus(spark):
    docs = spark.createDataFrame([(1, "solar panels on roofs"), (2, "wind farms"), (3, None)], "doc_id bigint, text string")
    ask = spark.createDataFrame([(9, "solar roof")], "query_id bigint, question string")
    rows = lexical.bm25(docs, "doc_id", "text", ask, "query_id", "question", 5).collect()
    assert [(r.doc_id, r.rank) for r in rows] == [(1, 1)] and rows[0].score > 0
    assert lexical.bm25(docs.limit(0), "doc_id", "text", ask, "query_id", "question", 5).count() == 0


def test_exact_vector_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "id bigint, v array<double>")
    got = vectors.top_k(rows, "id", "v", spark.createDataFrame([(7, [3.0, 0.0])], "query_id bigint, v array<double>"), 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (4, 1.0), (3, 0.707107)]
    assert vectors.top_k(rows, "id", "v", spark.createDataFrame([], "query_id bigint, v array<double>"), 3).count() == 0


def test_rank_fusion_and_threshold(spark):
    lists = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 2), (1, "b", 2, 1), (1, "c", 2, 2)], "q int, item string, list int, rank int")
    assert [r.item for r in ranking.reciprocal_rank_fusion(lists, "q", "item", "list", 2).orderBy("rank").collect()] == ["b", "a"]
    scored = spark.createDataFrame([(1, 0.01, 1), (1, 0.005, 2), (2, 0.9, 1), (2, 0.001, 2)], "q int, score double, rank int")
    got = {(r.q, r["rank"], r.low_relevance) for r in ranking.relevant(scored, "q").collect()}
    assert got == {(1, 1, True), (1, 2, True), (2, 1, False)}


def test_retrieval_config_needs_a_leg():
    with pytest.raises(ValueError):
        retrieval.RetrievalConfig(use_dense=False, use_bm25=False)


def test_questions_without_passages_are_answered(spark):
    docs = spark.createDataFrame([(1, "Solar panels produce power on sunny roofs all year long.")], "doc_id bigint, text string")
    ask = spark.createDataFrame([(1, "solar panels power", "concise"), (2, "quantum zebra", "long")], "query_id bigint, question string, style string")
    got = {r.query_id: r for r in retrieval.answer(docs, ask, retrieval.RetrievalConfig(use_dense=False)).collect()}
    assert got[1].answer.endswith("[1]") and got[1].confidence == "High"
    assert got[2].answer == T.NOT_FOUND and got[2].confidence == "Insufficient Evidence"


def test_citation_numbers_and_selection(spark):
    assert one(spark, T.cited_numbers(F.lit("a [1, 3] b [2][3] c [2024]"))) == [1, 2, 3]
    cited = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "query_id int, number int")
    said = spark.createDataFrame([(1, "x [2]"), (2, "no marker"), (3, "Insufficient evidence.")], "query_id int, answer string")
    assert {(r.query_id, r.number) for r in answers.select_cited(cited, said).collect()} == {(1, 2), (2, 1)}


def test_memory_is_bounded(spark):
    turns = spark.createDataFrame([("c", i, f"q{i}", f"answer [1] {i}") for i in range(9)] + [(None, 1, "q", "a")], "conversation_id string, turn bigint, question string, answer string")
    kept = library.remembered(turns).orderBy("turn").collect()
    assert [r.turn for r in kept] == [3, 4, 5, 6, 7, 8] and kept[0].answer == "answer 3"


def test_marks_are_withheld_and_events_sent(spark):
    def run(pieces):
        stream, shown = answers.shown_parts(pieces), []
        while True:
            try:
                shown.append(next(stream))
            except StopIteration as end:
                return "".join(shown), end.value

    mark = answers.FOLLOW_UP_MARK
    for text in (f"All is well.{mark}[1]", "No mark here <<<FOLLOW", f"{mark}", "", f"a <<< b{mark}x{mark}y"):
        for size in (1, 3, 7, 100):
            pieces = [text[i : i + size] for i in range(0, len(text), size)]
            visible, _, tail = text.partition(mark)
            assert run(pieces) == (visible, tail)
    answered = spark.createDataFrame([(1, "Yes [1].", "High"), (2, "No.", "Low")], "query_id int, answer string, confidence string")
    cited = spark.createDataFrame([(1, 1, "source-1", "c", "s", 0.5)], "query_id int, number int, id string, chunk_id string, snippet string, score double")
    got = {(r.query_id, r.seq, r.event): r.payload for r in answers.answer_events(answered, cited).collect()}
    assert got[1, 0, "sources"].startswith('[{"number":1') and got[2, 0, "sources"] == "[]" and got[1, 1, "token"] == '{"text":"Yes [1]."}' and '"High"' in got[1, 2, "done"]
    turns = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "conversation_id string, turn int")
    assert library.cleared(turns, spark.createDataFrame([("b",), ("z",), (None,)], "conversation_id string")).count() == 1


def test_upload_statuses(spark):
    rows = spark.createDataFrame([(1, "h1", "a.txt", "x"), (2, "h1", "b.txt", "x"), (3, "h2", "a.txt", "y"), (4, "h3", "c.txt", " ")], "o int, h string, n string, t string")
    assert [r.status for r in library.upload_status(rows, "h", "n", "o", "t").orderBy("o").collect()] == ["indexed", "duplicate", "replaced", "error"]


def test_metrics_of_a_known_ranking(spark):
    ranked = spark.createDataFrame([("q", i, "d", t) for i, t in enumerate(["noise one two", "alpha beta gamma delta", "other words here", "red green blue black"], 1)], "qid string, rank int, doc string, text string")
    evidence = spark.createDataFrame([("q", 1, "d", "alpha beta gamma delta"), ("q", 2, "d", "red green blue black")], "qid string, span_no int, doc string, span string")
    spans = spark.createDataFrame([("q", 2, False, 2)], "qid string, n_spans int, any_mode boolean, n_relevant int")
    m = evaluation.metrics(evaluation.graded(ranked, evidence), spans).first()
    assert (m.hit_1, m.hit_3, m.recall_3, m.recall_5, m.mrr, m.precision_5) == (0.0, 1.0, 0.5, 1.0, 0.5, 0.4)
    assert m.ndcg_10 == pytest.approx(0.650921, abs=1e-5)


def test_faithfulness_flags_foreign_numbers(spark):
    rows = spark.createDataFrame([("The solar plant produced 40 units in June overall.", "The solar plant produced 40 units in June overall."), ("The solar plant produced 99 units in June overall.", "The solar plant produced 40 units in June overall."), ("", "x")], "answer string, context string")
    assert [r.faithfulness for r in evaluation.faithfulness(rows).collect()] == [1.0, 0.0, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgh .!?\nABC", min_size=0, max_size=120), max_size=6), st.integers(40, 200))
def test_chunks_keep_all_words(parts, size):
    text = "\n\n".join(parts)
    for cut in (chunking.by_structure, chunking.by_windows, chunking.by_sentences, chunking.by_meaning):
        rows = cut([(1, text)], size, size // 4)
        assert set(text.split()) <= {w for r in rows for w in r[3].split()} | {w for w in text.split() if set(w) <= {"#"}}
        if cut is chunking.by_windows:
            assert all(len(r[3]) <= size for r in rows)


def test_chunk_sections_and_strategy_names(spark):
    rows = chunking.by_structure([(1, "# A\n\n" + "word " * 60 + "\n\n## B\n\n" + "text " * 60)], 200, 40)
    assert rows[0][2] == "A" and rows[-1][2] == "A > B"
    with pytest.raises(ValueError):
        chunking.chunk(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), "none")


def test_decoding_and_parsers():
    assert files.decode("é€".encode("cp1252")) == "é€" and files.decode("\ufeffx".encode()) == "x"
    assert files.decode("hi".encode("utf-16")) == "hi"
    assert "Row 2: a: 3; c: 4" in files.csv_text(b"a,b,c\n1,2,3\n3,,4\n")
    assert files.json_text(b'{"a":"\xc3\xa9"}') == '{\n  "a": "é"\n}' and files.json_text(b"{bad") == "{bad"
    page = files.html_text(b"<html><title>T</title><script>x</script><nav>n</nav><h2>Head</h2><p>Para</p><table><tr><td>1</td><td>2</td></tr></table><ul><li>i</li></ul>")
    assert page.startswith("# T") and "## Head" in page and "1 | 2" in page and "- i" in page and "x" not in page and "n" not in page.replace("Head", "").split("Para")[0].replace("\n", "")
    assert files.rst_headings("=====\nBig\n=====\n\nPart\n----\n\n.. note:: x\n.. a comment of prose\n.. code:: y\ntext\n\nSub\n~~~~\nNo title here\n--") == "# Big\n\n## Part\n\n.. a comment of prose\n.. code:: y\ntext\n\n### Sub\nNo title here\n--\n"


def test_docx_and_folder(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.txt").write_text("hello\r\nworld")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.txt").write_text("   ")
    got = {r.filename: (r.status.split(":")[0], r.text) for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("parsed", "# Head\n\na | b") and got["b.txt"] == ("parsed", "hello\nworld")
    assert got["c.exe"][0] == "unsupported" and got["d.docx"][0] == "BadZipFile" and got["e.txt"][0] == "empty"


def test_incremental_ingest(spark, tmp_path):
    from docloom.streaming import ingest

    for n, text in enumerate(["First text about one thing.", "Second text about another."]):
        spark.createDataFrame([(str(n), text), ("x", text)], "doc_id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.read_stream(spark, str(tmp_path / "in"), "doc_id string, text string")
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_names_its_queries():
    import __spark_entry__ as entry

    assert "hybrid_answers" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_sentence_scores_keep_passages_without_sentences(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1, "what drives solar power prices", "Solar power prices are driven by panels.", None), (1, "b", 2, "what drives solar power prices", "Too short.", None), (1, "c", 3, "what drives solar power prices", None, None), (2, "d", 1, "solar power", "Solar.", "Power"), (2, "e", 2, "solar power", None, None)],
        "query_id bigint, chunk_id string, rank int, question string, text string, section string",
    )
    got = {(r.query_id, r.chunk_id): r.score for r in ranking.sentence_scores(rows, "question", "text", "section").collect()}
    assert len(got) == 5 and got[1, "a"] > 0 and got[1, "b"] == got[1, "c"] == 0
    assert got[2, "d"] == 1.0 and got[2, "e"] == 0.01


def test_markers_and_citation_fields(spark):
    for text, want in (("a [1, 3] b", "a [1][3] b"), ("a [9] b", "a b"), ("year [2024] x [2;7]", "year [2024] x [2]"), ("[1]", "[1]"), (None, ""), ("none", "none")):
        assert one(spark, T.normal_markers(F.col("t").cast("string"), F.lit(3)), t=text) == want
    rows = spark.createDataFrame([(1, 1, "c", "d", "f.pdf", 3, 4, "S", "x" * 400, 0.123456)], "query_id int, rank int, chunk_id string, doc_id string, filename string, page int, page_end int, section string, text string, score double")
    cited = answers.citations(rows).first()
    assert (cited.id, cited.doc_id, cited.page_end, cited.section, len(cited.snippet), cited.score, cited.text) == ("source-1", "d", 4, "S", 303, 0.1235, "x" * 400)


def test_mmr_equals_brute_force_and_keeps_order_of_ties(spark):
    rng = np.random.default_rng(1)
    units = rng.normal(size=(12, 5))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    units[7] = units[3]
    asked = units[0]
    rows = [(1, f"c{i:02d}", 12 - i, units[i].tolist(), asked.tolist()) for i in range(12)]
    got = ranking.mmr(spark.createDataFrame(rows, "query_id bigint, item_id string, rank int, vector array<double>, query_vector array<double>")).orderBy("rank").collect()
    left, order = list(range(11, -1, -1)), []
    while left:
        worth = [0.7 * units[i] @ asked - 0.3 * max([units[i] @ units[j] for j in order], default=0.0) for i in left]
        order.append(left.pop(int(np.argmax(worth))))
    assert [r.item_id for r in got] == [f"c{i:02d}" for i in order]


def test_rerankers_fall_back_visibly(spark):
    chunks = spark.createDataFrame([("a", "d", "f.txt", "Solar panels produce power on sunny roofs all year long."), ("b", "d", "f.txt", "Wind farms produce power at night and in winter, says the report."), ("c", "e", "g.txt", None)], "chunk_id string, doc_id string, filename string, text string")
    ask = spark.createDataFrame([(1, "which panels produce solar power", "medium", 1), (2, "power at night", None, 0), (3, None, "long", 5), (4, "Summarise this report please", "long", 0)], "query_id bigint, question string, style string, top_k int")
    for wanted, plugged, scorer in (("mmr", retrieval.Models(), "keyword"), ("mmr", None, "mmr"), ("sentence", None, "sentence"), ("none", None, "none"), ("cross-encoder", None, "keyword")):
        got = retrieval.retrieve(chunks, ask, retrieval.RetrievalConfig(rerank=wanted), plugged=plugged).collect()
        assert {r.scorer for r in got if r.query_id != 4} == {scorer} and {r.query_id for r in got} == {1, 2, 4}
        assert [r.chunk_id for r in got if r.query_id == 1] == ["a"]
        assert {(r.mode, r.scorer, r.score) for r in got if r.query_id == 4} == {("summary", "none", 1.0)}
    scores = retrieval.Models(pairs=lambda pairs: [-9.0 for _ in pairs])
    low = retrieval.retrieve(chunks, ask, retrieval.RetrievalConfig(rerank="cross-encoder", summaries=False), plugged=scores).collect()
    assert low and all(r.low_relevance and r.scorer == "cross-encoder" for r in low if r.query_id != 4)

    def broken(pairs):
        raise ValueError("no")

    kept = retrieval.retrieve(chunks, ask, retrieval.RetrievalConfig(rerank="cross-encoder"), plugged=retrieval.Models(pairs=broken)).where("query_id = 2").collect()
    assert kept and {r.scorer for r in kept} == {"keyword"}
    scoped = retrieval.retrieve(chunks, ask, scope=spark.createDataFrame([("e",)], "doc_id string"))
    assert scoped.count() == 0
    assert retrieval.retrieve(chunks, ask, scope=spark.createDataFrame([], "doc_id string")).count() > 0
    with pytest.raises(ValueError):
        retrieval.RetrievalConfig(rerank="best")


def test_answers_by_a_model_and_without_documents(spark):
    chunks = spark.createDataFrame([("a", "d", "Solar panels produce power on sunny roofs all year long.")], "chunk_id string, doc_id string, text string")
    ask = spark.createDataFrame([(1, "solar panels power", "concise"), (2, "panels fail", "concise")], "query_id bigint, question string, style string")

    def write(prompt):
        if prompt.startswith("panels fail"):
            raise RuntimeError("quota exceeded")
        return "By panels [1, 4].<<<FOLLOWUPS>>> []"

    plugged = retrieval.Models(generate=write)
    got = {r.query_id: r for r in retrieval.answer(chunks, ask, plugged=plugged).collect()}
    assert got[1].answer == "By panels [1]." and got[1].llm_used and got[1].notice is None
    assert "quota" in got[2].notice and got[2].answer.startswith("> **Extractive answer**") and not got[2].llm_used
    none = retrieval.answer(chunks.limit(0), ask).first()
    assert none.answer == retrieval.NO_DOCUMENTS and none.mode == "none"
    gone = retrieval.answer(chunks, ask, scope=spark.createDataFrame([("z",)], "doc_id string")).first()
    assert gone.answer == retrieval.NONE_LEFT
    row = retrieval.status(chunks, chunks, retrieval.RetrievalConfig(rerank="cross-encoder"), retrieval.Models()).first()
    assert (row.documents, row.chunks, row.reranker, row.vectors_ready, len(row.warnings)) == (1, 1, "keyword", False, 3)


def test_model_plug_points(spark):
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError("timed out, retry after 2 s")
        return "ok"

    assert models.with_retries(flaky, sleep=waits.append)() == "ok" and waits == [2.5, 2.5]
    with pytest.raises(ValueError):
        models.with_retries(lambda: (_ for _ in ()).throw(ValueError("bad")), sleep=waits.append)()
    assert models.rewritten('```json\n{"standalone": "What of Q4?", "queries": ["q4", "WHAT OF Q4?", 5, "x", "y", "z"]}```', "and Q4?") == ["What of Q4?", "and Q4?", "q4", "x"]
    assert models.rewritten("no json", " a ") == ["a"] and models.rewritten(None, "a") == ["a"]
    assert one(spark, models.judged(lambda p: '{"verdict": 0.5}', F.col("t")), t="x") == 0.5 and one(spark, models.judged(lambda p: "?", F.col("t")), t="x") is None
    assert one(spark, vectors.embedder_of(lambda texts: [[len(t), 1] for t in texts], prefix="q: ")(F.col("t")), t="abc") == [6.0, 1.0]
    assert vectors.embedder("none") is None and vectors.embedder("other") is None and vectors.embedder("own", plugged={"own": lambda: len}) is len


def test_bootstraps(spark):
    rows = [("base", i, 0.2 + 0.01 * (i % 5)) for i in range(40)] + [("better", i, 0.6 + 0.01 * (i % 7)) for i in range(40)] + [("same", i, 0.2 + 0.01 * (i % 5)) for i in range(40)] + [("partial", i, 0.9) for i in range(3)]
    scores = spark.createDataFrame(rows, "config string, item int, mrr double")
    got = {r.config: r for r in evaluation.paired_bootstrap(scores, "config", "item", "mrr", "base").collect()}
    assert set(got) == {"better", "same"} and got["better"].p < 0.01 and got["same"].p == 1.0
    ci = {r.config: r for r in evaluation.exact_bootstrap(scores, "config", "mrr").collect()}
    assert ci["base"].low < ci["base"].mean < ci["base"].high and ci["partial"].low == ci["partial"].high == 0.9


def test_store_adds_replaces_deletes_and_indexes(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id string, filename string, file_type string, size_bytes bigint, text string")
    assert held.documents().count() == 0 and held.in_sync()
    said = {r.doc_id: r.status for r in held.add(docs(("a", "x.txt", "txt", 9, "First text about one thing."), ("b", "y.txt", "txt", 9, "Second text."), ("e", "e.txt", "txt", 0, " "))).collect()}
    assert said == {"a": "indexed", "b": "indexed", "e": "error"}
    assert {r.doc_id: r.status for r in held.add(docs(("a", "x.txt", "txt", 9, "First text about one thing."), ("c", "y.txt", "txt", 9, "New second text."))).collect()} == {"a": "duplicate", "c": "replaced"}
    assert {r.doc_id for r in held.documents().collect()} == {"a", "c"} and {r.doc_id for r in held.chunks().collect()} == {"a", "c"} and held.in_sync()
    assert held.documents().first().doc_id == "c" and held.totals().first().chunks == 2
    got = held.vectors_of(spark.createDataFrame([(0, "c_c0"), (1, "a_c0")], "place int, chunk_id string")).collect()
    assert [r.chunk_id for r in got] == ["c_c0", "a_c0"] and len(got[0].embedding) == 64
    other = store.Store(spark, str(tmp_path / "s"), signature="other")
    assert not other.in_sync()
    with pytest.raises(store.NotReady):
        other.vectors_of(spark.createDataFrame([], "place int, chunk_id string"))
    assert other.ensure_index() and other.in_sync()
    wrong = store.Store(spark, str(tmp_path / "s"), signature="wrong", dim=7)
    assert not wrong.ensure_index() and "dimensions" in wrong.last_error and not wrong.ensure_index()
    assert held.delete(spark.createDataFrame([("a",), ("zz",)], "doc_id string")) == 1 and held.documents().count() == 1
    held.add(docs(("a", "x.txt", "txt", 9, "First text about one thing.")))
    assert {r.doc_id for r in held.documents().collect()} == {"a", "c"}
    (tmp_path / "s" / "chunks" / "batch=lost").mkdir()
    assert held.compact(str(tmp_path / "t")).chunks().count() == 2


def test_readers_of_questions_corpora_and_pages(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "a?"}\n\n{"id": "2", "question": "b?", "evidence": [{"doc": "d", "text": "t"}], "evidence_mode": "any"}\n')
    got = {r.id: (len(r.evidence), r.evidence_mode) for r in files.read_questions(spark, str(tmp_path / "q.jsonl")).collect()}
    assert got == {"1": (0, "all"), "2": (1, "any")}
    (tmp_path / "one.txt").write_text("hello")
    assert [tuple(r) for r in files.read_corpus(spark, str(tmp_path)).collect()] == [("one", "hello")]
    with pytest.raises(files.PluginMissing):
        files.pdf_text(b"")
    files.PDF.update(pages=lambda raw, password: [("exam-\nple of\na page that is long", []), ("", ["img"]), ("", [])], ocr=lambda image: "read " + image)
    try:
        assert files.pdf_pages(b"x") == ["example of a page that is long", "read img", ""]
        files.PDF["ocr"] = None
        assert files.pdf_pages(b"x")[1] == ""
    finally:
        files.PDF.update(pages=None, ocr=None)


def test_oversized_files_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_BYTES", 10)
    (tmp_path / "a.txt").write_text("x" * 11)
    (tmp_path / "b.txt").write_text("small")
    got = {r.filename: (r.status, r.doc_id is None) for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("too large", True), "b.txt": ("parsed", False)}
    plan = files.read_folder(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_ingest_with_a_new_checkpoint_keeps_earlier_chunks(spark, tmp_path):
    from docloom.streaming import ingest

    for n in range(2):
        spark.createDataFrame([(str(n), f"Text number {n} about things.")], "doc_id string, text string").write.mode("overwrite").parquet(str(tmp_path / f"in{n}"))
        ingest.ingest(ingest.read_stream(spark, str(tmp_path / f"in{n}"), "doc_id string, text string"), str(tmp_path / "out"), str(tmp_path / f"ck{n}")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_event_counts_and_memory_streams(spark, tmp_path):
    import datetime as dt

    from docloom.streaming import ingest

    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    spark.createDataFrame([(at(1), "a", 1.0), (at(2), "a", 2.0), (at(3), "b", 5.0)], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "ev"))
    counted = ingest.event_counts(ingest.read_stream(spark, str(tmp_path / "ev"), "ts timestamp, event_type string, value double"))
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination(60)
    assert {(r.event_type, r.n, r.total) for r in spark.table("counted").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}
    spark.createDataFrame([("c", i, f"q{i}", f"a{i} [1]") for i in range(9)] + [(None, 1, "q", "a")], "conversation_id string, turn bigint, question string, answer string").write.parquet(str(tmp_path / "turns"))
    held = ingest.memory(ingest.read_stream(spark, str(tmp_path / "turns"), "conversation_id string, turn bigint, question string, answer string"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    running = held.writeStream.format("memory").queryName("held").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    until = time.time() + 90
    while time.time() < until and spark.table("held").isEmpty():  # pending timers keep such a query going
        time.sleep(0.5)
    running.stop()
    assert sorted({r.turn for r in spark.table("held").collect()})[-6:] == [3, 4, 5, 6, 7, 8]


def test_written_index_gives_the_same_search(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} word{i % 5} common text") for i in range(40)] + [(99, None)], "doc_id bigint, text string")
    ask = spark.createDataFrame([(1, "word1 word4"), (2, "common")], "query_id bigint, question string")
    lexical.write_index(docs, "doc_id", "text", str(tmp_path / "i"))
    search = lambda index: sorted(map(tuple, lexical.bm25(docs, "doc_id", "text", ask, "query_id", "question", 5, index=index).collect()))
    assert search(None) == search(lexical.read_index(spark, str(tmp_path / "i")))


def test_hot_terms_are_joined_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 3} common text") for i in range(60)], "doc_id bigint, text string")
    ask = spark.createDataFrame([(1, "word1 common"), (2, "common")], "query_id bigint, question string")
    search = lambda: sorted(map(tuple, lexical.bm25(docs, "doc_id", "text", ask, "query_id", "question", 7).collect()))
    whole = search()
    monkeypatch.setattr(lexical, "HOT", 9)
    assert search() == whole and len(whole) == 14


def test_vector_search_in_several_passes_with_string_keys(spark, monkeypatch):
    rng = np.random.default_rng(3)
    held = rng.normal(size=(60, 4)).round(3)
    rows = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(held)], "id string, v array<double>")
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(held[:7])], "query_id string, v array<double>")
    whole = sorted(map(tuple, vectors.top_k(rows, "id", "v", asked, 3).collect()))
    monkeypatch.setattr(vectors, "QUERIES_PER_PASS", 3)
    assert sorted(map(tuple, vectors.top_k(rows, "id", "v", asked, 3).collect())) == whole and len(whole) == 21


def test_checkpoints_need_a_shared_folder_off_local_mode(spark, monkeypatch):
    from docloom import session

    class Context:
        master = "spark://host"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()

    frame = type("D", (), {"sparkSession": type("P", (), {"sparkContext": Context, "conf": type("C", (), {"get": lambda self, name, other: None})()})()})()
    with pytest.raises(RuntimeError):
        session.cut_lineage(frame)


def test_experiments_resume_and_report(spark, tmp_path):
    from docloom.operators import experiments

    docs = spark.createDataFrame([("d1", "a.txt", "# Solar\n\nSolar panels produce power on sunny roofs all year long.\n\n# Wind\n\nWind farms produce power at night in winter."), ("d2", "b.txt", "Hydro dams store water for dry months of the year.")], "doc_id string, filename string, text string")
    asked = spark.createDataFrame([(1, "what do solar panels produce", "fact", [("a.txt", "Solar panels produce power on sunny roofs")], "all"), (2, "dams store water", "fact", [("b.txt", "Hydro dams store water for dry months")], "any"), (3, "zebra", "unanswerable", [], "all")], "query_id bigint, question string, type string, evidence array<struct<doc:string,text:string>>, evidence_mode string")
    ways = {k: experiments.RETRIEVALS[k] for k in ("bm25-only", "hybrid+keyword", "hybrid+cross-encoder")}
    cuts = {"structure-250": experiments.CHUNKINGS["structure-250"]}
    left = experiments.run(spark, docs, asked, str(tmp_path), cuts, {"bm25-only": ways["bm25-only"]})
    assert left == {}
    left = experiments.run(spark, docs, asked, str(tmp_path), cuts, ways)
    assert left["structure-250", "bm25-only"] == "finished before" and "cross-encoder" in left["structure-250", "hybrid+cross-encoder"]
    rows = experiments.results(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and all(r.recall_5 == r.max_recall == 1.0 and r.mrr == 1.0 for r in rows)
    shown = experiments.report(spark, str(tmp_path))
    assert "| structure-250 | hybrid+keyword | 1.0 | 1.0 | 1.0 |" in shown and "| MRR | bm25-only | hybrid+keyword |" in shown
    trace = experiments.Trace()
    with trace.stage("a"), trace.stage("b"):
        pass
    with trace.stage("a"):
        pass
    assert set(trace.stages) == {"a", "b"} and trace.stages["a"] > trace.stages["b"]


def _bm25_by_hand(docs, asked, k, within=None):
    """Brute force over entries (key, text): counts are those of distinct (key, length), scores of a key add up."""
    entries: dict = {}
    for key, text in docs:
        terms = (text or "").split()
        entries.setdefault((key, len(terms)), []).extend(terms)
    mean = sum(len((t or "").split()) for _, t in docs) / len(docs)
    out = []
    for q, question in asked:
        scores: dict = {}
        for term in dict.fromkeys(question.split()):
            having = {e: terms.count(term) for e, terms in entries.items() if term in terms}
            idf = np.log(1 + (len(docs) - len(having) + 0.5) / (len(having) + 0.5))
            for (key, size), tf in having.items():
                scores[key] = scores.get(key, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))
        shown = sorted((-round(s, 6), key) for key, s in scores.items() if within is None or key in within)[:k]
        out += [(q, key, -s, rank) for rank, (s, key) in enumerate(shown, 1)]
    return out


@pytest.mark.parametrize("most", [40, 1_000_000])
def test_bm25_search_by_blocks_equals_brute_force(spark, monkeypatch, most):
    rng = np.random.default_rng(5)
    words = [f"w{i}x" for i in range(30)]
    text = lambda n: " ".join(words[i] for i in np.minimum(rng.zipf(1.5, size=n), 30) - 1)
    docs = [(i, text(int(rng.integers(1, 9)))) for i in range(90)] + [(200 + i, "w1x w2x w3x") for i in range(12)]
    docs += [(7, text(12)), (7, docs[7][1]), (300, None), (301, "")]
    asked = [(i, " ".join(dict.fromkeys(text(int(rng.integers(1, 6))).split()))) for i in range(40)]
    within = [(i,) for i in range(0, 210, 3)]
    monkeypatch.setattr(lexical, "HOT", most)
    rows, questions = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(asked, "query_id bigint, question string")
    for scope, keys in ((None, None), (spark.createDataFrame(within, "doc_id bigint"), {k for k, in within})):
        got = lexical.bm25(rows, "doc_id", "text", questions, "query_id", "question", 5, scope=scope).orderBy("query_id", "rank").collect()
        assert list(map(tuple, got)) == _bm25_by_hand(docs, asked, 5, keys)


def test_bm25_search_shuffles_no_pairs(spark):
    docs = spark.createDataFrame([(i, f"common own{i}") for i in range(300)], "doc_id bigint, text string")
    ask = spark.createDataFrame([(i, f"common own{i}") for i in range(300)], "query_id bigint, question string")

    def stages():
        context = spark.sparkContext
        listed = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteRecords() for x in map(listed.apply, range(listed.size()))}

    before = stages()
    assert lexical.bm25(docs, "doc_id", "text", ask, "query_id", "question", 3).count() == 900
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(n for k, n in stages().items() if k not in before) < 20_000  # 90,000 pairs share a term


def test_hybrid_retrieval_shuffles_no_pairs(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"common own{i}") for i in range(400)], "chunk_id string, text string").localCheckpoint()
    ask = spark.createDataFrame([(i, f"common own{i}") for i in range(400)], "query_id bigint, question string").localCheckpoint()

    def stages():
        context = spark.sparkContext
        listed = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteRecords() for x in map(listed.apply, range(listed.size()))}

    before = stages()
    config = retrieval.RetrievalConfig(candidate_k=3, summaries=False)
    rows = retrieval.retrieve(chunks, ask, config).where("rank = 1").collect()
    assert len(rows) == 400 and all(r.chunk_id == f"c{r.query_id}" and r.text == f"common own{r.query_id}" for r in rows)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(n for k, n in stages().items() if k not in before) < 40_000  # 160,000 pairs share a term


def test_diverse_retrieval_shuffles_no_vectors_of_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}x" for i in range(40)]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, 40, size=n))
    texts = {f"c{i:03d}": text(12) for i in range(300)}
    texts |= {"c300": texts["c007"], "c301": "", "c302": texts["c007"]}
    asked = {i: texts[f"c{i:03d}"] if i % 3 else text(3) for i in range(200)}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string").localCheckpoint()
    ask = spark.createDataFrame([(q, t, ("concise", "medium", "long")[q % 3]) for q, t in asked.items()], "query_id bigint, question string, style string").localCheckpoint()

    def stages():
        context = spark.sparkContext
        listed = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() for x in map(listed.apply, range(listed.size()))}

    got = {}
    written = {}
    for rerank in ("none", "mmr"):
        before = stages()
        rows = retrieval.retrieve(chunks, ask, retrieval.RetrievalConfig(rerank=rerank, summaries=False)).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        written[rerank] = sum(n for k, n in stages().items() if k not in before)
        got[rerank] = rows
    assert written["mmr"] < 1.15 * written["none"]  # vectors and texts of the 5,000 pairs are a multiple of it
    lists, _ = retrieval.ranked_lists(retrieval.as_chunks(chunks), retrieval.prepared(ask, config := retrieval.RetrievalConfig(summaries=False), retrieval.default_models(config)), config, retrieval.default_models(config))
    fused = ranking.reciprocal_rank_fusion(lists, "query_id", "chunk_id", "list", 25)
    pairs = fused.join(chunks, "chunk_id").join(ask, "query_id").select("query_id", F.col("chunk_id").alias("item_id"), "rank", vectors.embedded(F.col("text")).alias("vector"), vectors.embedded(F.col("question")).alias("query_vector"))
    want = {(r.query_id, r.item_id, r.score, r.rank) for r in ranking.mmr(pairs).collect() if r.rank <= (4, 6, 10)[r.query_id % 3]}
    assert {(r.query_id, r.chunk_id, r.score, r.rank) for r in got["mmr"]} == want and len(got["mmr"]) == len(want)
    assert all(r.text == texts[r.chunk_id] and r.scorer == "mmr" and r.mode == "hybrid" and not r.low_relevance for r in got["mmr"])


@pytest.mark.parametrize("most", [3, 4096])
def test_mmr_by_blocks_keeps_null_vectors_and_drops_unknown_items(spark, monkeypatch, most):
    rng = np.random.default_rng(4)
    units = rng.normal(size=(20, 5)).tolist()
    units[6] = units[2]
    monkeypatch.setattr(ranking, "ITEMS_PER_BLOCK", most)
    near = [(q, f"i{i:02d}", n + 1) for q in range(9) for n, i in enumerate(rng.permutation(20)[: 4 + q % 3].tolist())]
    near += [(9, "gone", 1), (9, "i00", 2), (9, "void", 3), (9, "i01", 4), (10, "gone", 1), (11, "i06", 1), (11, "i02", 2)]
    asked = [(q, rng.normal(size=5).tolist() if q != 8 else None, 1 + q % 4) for q in range(13)]
    items = [(f"i{i:02d}", v) for i, v in enumerate(units)] + [("void", None), ("other", units[0])]
    vector = {key: np.zeros(5) if v is None else np.array(v) for key, v in items}
    got = ranking.mmr_of_kept(spark.createDataFrame(near, "query_id bigint, item_id string, rank int"), spark.createDataFrame(asked, "query_id bigint, vector array<double>, k int"), spark.createDataFrame(items, "item_id string, vector array<double>").repartition(2)).collect()
    want = []
    for q, own, k in asked:
        own = np.zeros(5) if own is None else np.array(own)
        left, order = [i for p, i, _ in sorted(near, key=lambda r: (r[0], r[2])) if p == q and i in vector], []
        while left and len(order) < k:
            worth = [0.7 * vector[i] @ own - 0.3 * max([vector[i] @ vector[j] for j in order], default=0.0) for i in left]
            order.append(left.pop(int(np.argmax(worth))))
            want.append((q, order[-1], round(max(float(vector[order[-1]] @ own), 0.0), 6), len(order)))
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[3])) == want
