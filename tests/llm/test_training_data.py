import base64
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import answer_defects, leaked_items, markup, near_duplicates, page_body, scan_noise, score_fusion, search_bait, shared_spans, token_ids

LONG = "word " * 60_000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_names_and_text_pairs(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w50 ", "zz ").replace("w120 ", "")
    src = frame(spark, [("a", base, "x"), ("a", base, "x"), ("b", near, "y"), ("c", base, "z"), ("d", None, "n"), ("e", " ", "n"), ("f", "one two", "n"), ("g", LONG, "n")], "doc_id string, raw_text string, runs string")
    reg = frame(spark, [("a", "Copy of Annual-Report_v2.pdf"), ("b", "annual%20report (1).PDF"), ("c", "Anual Report FINAL.docx"), ("d", "annual report 2024.pdf"), ("e", "annual report 2025.pdf"), ("f", None), ("g", "")], "doc_id string, filename string")
    got = {tuple(r) for r in near_duplicates.find_pairs(src, reg).collect()}
    assert got == {("raw_text", "a", "b"), ("raw_text", "a", "c"), ("raw_text", "b", "c"), ("filename", "a", "b"), ("filename", "a", "c"), ("filename", "b", "c")}
    assert near_duplicates.find_pairs(src.limit(0), reg.limit(0)).count() == 0
    groups = {r.id: r.group_id for r in near_duplicates.text_groups(src.select(F.col("doc_id").alias("id"), F.col("raw_text").alias("text"))).collect()}
    assert groups == {"a": "a", "b": "a", "c": "a", "g": "g"}


def test_groups_of_long_chains_and_many_near_copies(spark):
    chain = [(f"{i:05d}", f"{i + 1:05d}") for i in range(300)]
    members = frame(spark, [(f"{i:05d}", f"{i:05d}") for i in range(310)], "id string, cls string")
    groups = {r.id: r.group_id for r in near_duplicates.classes(members, frame(spark, chain, "a string, b string")).collect()}
    assert {groups[f"{i:05d}"] for i in range(301)} == {"00000"} and groups["00305"] == "00305" and len(groups) == 310
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    near = lambda: " ".join(w if rng.random() > 0.01 else f"x{rng.randint(0, 9)}" for w in base)
    rows = [(f"n{i:04d}", near()) for i in range(1500)] + [(f"o{i}", " ".join(f"v{rng.randint(0, 900)}" for _ in range(60))) for i in range(50)]
    got = {r.id: r.group_id for r in near_duplicates.text_groups(frame(spark, rows, "id string, text string")).collect()}
    assert {got[k] for k, _ in rows[:1500]} == {"n0000"} and all(got[k] == k for k, _ in rows[1500:])


def test_hot_variant_keeps_every_pair(spark):
    rows = frame(spark, [("k", f"{i:04d}") for i in range(1200)], "key string, id string")
    assert near_duplicates.meetings(rows, "key", "id").distinct().count() == 1200 * 1199 // 2


def test_fusion_ignores_ranges(spark):
    chunk = "array<struct<chunk_id:string,doc_id:string,score:double>>"
    lists = [(1, "big", [("a", "d", 1e6), ("b", "d", 9e5), ("c", "d", 1.0)]), (1, "small", [("b", "d", 0.9), ("a", "d", 0.1), ("c", "d", 0.2)]), (1, "third", [("b", "d", 5.0), ("a", "d", None), ("c", "d", float("nan"))]), (2, "one", [("z", "d", 1.0)]), (3, "x", []), (3, "y", None), (3, "z", [("q", "d", 1.0)])]
    results = frame(spark, lists + lists[:1], f"query_id bigint, scorer string, chunks {chunk}")
    cited = frame(spark, [(1, "b", 3.0), (1, "b", 3.0), (1, "a", -2.0), (None, "a", 1.0)], "query_id bigint, chunk_id string, score double")
    ranked = score_fusion.fuse(results, cited)
    assert {tuple(r) for r in score_fusion.heads(ranked).collect()} == {(1, "b"), (3, "q")}
    assert all(0 <= r.closeness <= 1 for r in ranked.collect())
    assert score_fusion.fuse(results.limit(0), cited.limit(0)).count() == 0


def test_scan_noise_and_repair(spark):
    words = "system supplier reports measured several important results during regular official committee sessions throughout northern districts"
    clean = [(f"c{i}", "txt", None, f"Notes on the season\n\nThe {words} before winter. The {words} after winter.\n\nEvery {words} again and again for years.") for i in range(30)]
    page = "\n".join(["REPORT OF THE YEAR", "The systern supplier reports measured several impor-", "tant results during", "- 4 -", "REPORT OF THE YEAR", "regular official committee", "- 5 -", "REPORT OF THE YEAR", "sessions throughout northern districts before winter."])
    src = frame(spark, clean + [("p", "pdf", None, page), ("q", "pdf", None, None), ("r", "pdf", None, " "), ("s", "pdf", None, "one line")], "doc_id string, file_type string, origin string, raw_text string")
    got = {(r.doc_id, r.noise_kind) for r in scan_noise.find_noise(src).collect()}
    assert {("p", "hyphen_break"), ("p", "misread")} <= got and {d for d, _ in got} == {"p"}
    fixed = {r.doc_id: r.clean_text for r in scan_noise.repair(src).collect()}
    assert "system supplier" in fixed["p"] and "important" in fixed["p"]
    assert scan_noise.find_noise(src.limit(0)).count() == 0


def test_repeated_slips_are_left_to_the_model():
    words = "system supplier reports measured several important results during regular official committee sessions throughout northern districts number members summer remember common"
    texts = [f"Notes on the season {i}\n\nThe {words} before winter. The {words} after winter.\n\nEvery {words} again and again for years." for i in range(40)]
    model = scan_noise.train(texts, Counter({w: 40 for w in words.split()}))["editor"]
    assert scan_noise.best_edit("systern", {"systern": 9, "system": 40}, model) == "system"
    assert scan_noise.best_edit("system", {"systern": 9, "system": 40}, model) is None


def test_edits_of_long_words(spark):
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("eictfdclrnmuvwhbi0") for _ in range(rng.randint(3, 12)))
        for fixed, edits in scan_noise.corrections(word).items():
            assert scan_noise.edits_between(word, fixed) == edits and scan_noise.skeleton(word) == scan_noise.skeleton(fixed)
    words = "the district authorities measured several important results throughout Donaudampfschifffahrtsgesellschaft during regular sessions"
    clean = [(f"c{i}", "txt", None, f"Notes on the season {i}\n\nAfter the winter {words} before spring came. The {words} after summer.\n\nEvery {words} again and again for years.") for i in range(40)]
    page = words.replace("dampf", "darnpf").replace("gesell", "gcsell") + " before winter."
    src = frame(spark, [*clean, ("p", "pdf", None, page)], "doc_id string, file_type string, origin string, raw_text string")
    assert "Donaudampfschifffahrtsgesellschaft" in scan_noise.repair(src).first().clean_text


def test_copies_of_a_scan_keep_its_misreads(spark):
    words = "system supplier reports measured several important results during regular official committee sessions throughout northern districts"
    clean = [(f"c{i}", "txt", None, f"Notes on the season {i}\n\nThe {words} before winter. The {words} after winter.\n\nEvery {words} again and again for years.") for i in range(40)]
    copies = [(f"p{i}", "pdf", None, "The systern supplier reports measured several important results before winter." + " " * (i % 3)) for i in range(20)]
    src = frame(spark, clean + copies, "doc_id string, file_type string, origin string, raw_text string")
    assert {d for d, kind in scan_noise.find_noise(src).collect() if kind == "misread"} == {d for d, *_ in copies}
    assert all("The system supplier" in r.clean_text for r in scan_noise.repair(src).collect())


def test_words_beyond_any_length_and_long_scans():
    rng, lines = random.Random(1), []
    for page in range(2000):
        lines += [str(page + 1), "", scan_noise._misread(rng, "The annual report of the committee", 1.0), f"some words of a line that goes on over the page {rng.random()}", "and is broken in the middle of a sentence which goes"]
    began = time.time()
    found = scan_noise.line_features(lines)
    assert time.time() - began < 2 and len({i for i, _, kind in found if kind == "running_head"}) > 1900
    assert sum(kind == "page_number" for _, _, kind in found) == 2000


def brute_spans(records):
    seen = {}
    for key, text in records.items():
        for j in range(len(text) - 99):
            seen.setdefault(text[j : j + 100], set()).add(key)
    out = set()
    for key, text in records.items():
        hit = [False] * len(text)
        for j in range(len(text) - 99):
            if len(seen[text[j : j + 100]]) > 1:
                hit[j : j + 100] = [True] * 100
        out |= {(key, m.start() + 1, m.end() - m.start()) for m in re.finditer("x+", "".join("x" if h else "." for h in hit))}
    return out


def test_spans_equal_brute_force(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice(a) for _ in range(rng.randint(90, 400))) for a in ["abc def. ", "x", "abcdefghij", "中文字 ", "é😀1 ,"] for _ in range(4)]
    records = {}
    for i in range(90):
        part = rng.choice(pool)
        a = rng.randint(0, len(part) // 2)
        records[f"r{i}"] = "".join(rng.choice("qwe rty") for _ in range(rng.randint(0, 30))) + part[a : rng.randint(a, len(part))] + rng.choice(pool)[: rng.randint(0, 200)]
    rows = [*records.items(), ("n", None), ("b", " " * 200), *list(records.items())[:5]]
    got = {tuple(r) for r in shared_spans.shared_spans(frame(spark, rows, "record_id string, text string")).collect()}
    assert got == brute_spans(records)
    assert shared_spans.shared_spans(frame(spark, [], "record_id string, text string")).count() == 0


@pytest.mark.parametrize(
    ("text", "kinds"),
    [("<p>x</p> &amp; y", ["html"]), ("a **bold** move", ["markdown"]), ("see [[Page|name]] and {{cite|x}}", ["wiki"]), ("as \\emph{shown} in $k_{3}$", ["latex"]), ("If a < 3 and b > 2, R&D pays $7 in A and $8 in B; method __init__ takes *args and **kwargs; [[1, 2], [3, 4]]", []), ("* item one\n* item two\n- three", []), (None, []), ("", [])],
)
def test_markup_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_markup_rows_and_clean_text(spark):
    rows = frame(spark, [("raw_text", "a", "<h2>T</h2><ul><li>i</li></ul><pre>x=1</pre>"), ("raw_text", "a", "<h2>T</h2><ul><li>i</li></ul><pre>x=1</pre>"), ("raw_text", "b", None), ("raw_text", None, "<b>x</b>"), ("raw_text", "c", LONG)], "field_name string, record_id string, text string")
    assert [tuple(r) for r in markup.find_markup(rows).collect()] == [("raw_text", "a", "html")]
    clean = {r.record_id: r.clean_text for r in markup.clean_records(rows).collect()}
    assert "## T" in clean["a"] and "- i" in clean["a"] and "```\nx=1\n```" in clean["a"] and clean["b"] is None
    assert markup.clean("\\section{A}\n\\begin{itemize}\n\\item b\n\\end{itemize}\n$x^2$") == "## A\n- b\n$x^2$"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("== History ==\nA [[Page|name]] and {{cite|x}} here.\n\n# Title\n** a\n** b", "## History\nA name and here.\n\n# Title\n- a\n- b"),
        ("# Title\n\nA **bold** [link](http://a.b/c) and `x*y*z` here\n\n```\n*a* <b>\n```\n\nSub\n---------\nmore", "# Title\n\nA bold link and `x*y*z` here\n\n```\n*a* <b>\n```\n\n## Sub\nmore"),
        ("<h2>T</h2><ul><li>i</li></ul><p>a &amp; b <code>q</code></p><!-- x -->", "## T\n\n- i\n\na & b `q`"),
        ("\\section{A}\nb \\emph{c} see~\\ref{q}, \\[ a=b \\] and 5\\% more, $x_{1}$ kept", "## A\nb c see, $a=b$ and 5% more, $x_{1}$ kept"),
        ("== H ==\n<b>x</b> **y** \\emph{z}", "## H\nx y z"),
        ("If a < 3 and b > 2, *args costs $7 in A.\n\n* item", "If a < 3 and b > 2, *args costs $7 in A.\n\n* item"),
    ],
)
def test_clean_text_by_nodes(text, want):
    assert markup.clean(text) == want


def test_constructs_of_any_length():
    assert markup.kinds_of(f"[a](http://b.test/{'c' * 1000})") == ["markdown"]
    assert markup.kinds_of("{{Infobox\n" + "|name=value\n" * 100 + "}} text") == ["wiki"]
    assert markup.kinds_of(f"so $${'a_1 + ' * 200}b$$ holds") == ["latex"]
    assert markup.clean("x **" + "long words " * 100 + "end** y") == "x " + "long words " * 100 + "end y"
    assert markup.kinds_of("*a __b ~~c `d $e [f {{g <i" * 20_000) is not None  # ends in time in proportion to the text


def test_page_bodies(spark):
    rng = random.Random(4)
    noun = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    sentence = lambda: f"The {noun()} of the {noun()} told a long story about the {noun()} and its {noun()}."

    def page():
        lines = ["Home | Shop | Help" if rng.random() < 0.8 else "Shop | Home", "", f"The {noun()} of the {noun()}", "", sentence()]
        gone = [1]
        if rng.random() < 0.6:
            lines.append(f"Read also: Notes on the {noun()}")
            gone.append(len(lines))
        lines += ["", f"Notes on the {noun()}", sentence(), f"- {noun()} of {noun()}", f"- {noun()} of {noun()}", sentence(), "", "Related articles", f"- Story of the {noun()}", f"Notes on the {noun()}", "", f"© {rng.randint(2000, 2024)} {noun()}. All rights reserved"]
        return "\n".join(lines), [*gone, len(lines) - 4, len(lines) - 3, len(lines) - 2, len(lines)]

    pages = {f"d{i:03d}": page() for i in range(90)}
    rows = [(k, "hot" if i % 3 else f"s{i}", text, "x") for i, (k, (text, _)) in enumerate(pages.items())]
    src = frame(spark, [*rows, *rows[:3], ("n", None, rows[0][2], "x"), ("z", "s", None, "x"), ("y", "s", "  ", "x")], "doc_id string, origin string, raw_text string, path string")
    got = {tuple(r) for r in page_body.find_boilerplate(src).collect()}
    want = {(k, n) for k, (_, lines) in pages.items() for n in lines}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert page_body.main_bodies(src).where("doc_id = 'd000'").first().text.startswith("The ")
    assert page_body.find_boilerplate(src.limit(0)).count() == 0
    assert page_body.find_boilerplate(src.where("doc_id = 'd000'")).count() > 0


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [("Who?", None, "empty_answer"), ("Who?", " \u200b", "empty_answer"), ("Who?", "[1]", "empty_answer"), ("What is the price of tea?", "I'm sorry, but I can't help with that.", "refusal"), ("What is it?", "The clerk declined to comment on the tea, so it was closed.", None), ("Which boat crossed the sea?", "You asked: Which boat crossed the sea?", "copies_question"), ("Which boat crossed the sea?", "Which boat crossed the sea? The red boat of the north crossed it in May.", None), ("Which boat crossed the sea?", "Das rote Boot hat das Meer im Mai mit der Mannschaft nicht überquert.", "other_language"), ("Which boat crossed the sea?", "It was the red boat (de: \"Das rote Boot der Stadt war es nicht und nie\") of the north.", None), ("Which boat?", "It was the red boat that crossed the", "truncated"), ("Which code?", "SK-360", None), ("Which?", "These are they.\n- one thing\n- another thing", None), ("Which?", "So:\n```\nx = 1", "truncated")],
)
def test_answer_defects(question, answer, defect):
    assert answer_defects.defect_of(question, answer) == defect


def test_long_refusals_and_repeated_questions():
    assert answer_defects.is_refusal("I am sorry, but I cannot help with that part. " * 40)
    assert not answer_defects.is_refusal("I am sorry, but I cannot help with that part. " * 40 + "The plant opened in 1990.")
    assert answer_defects.copies("How tall is the old tower? " * 20, "How tall is the old tower?")
    assert answer_defects.copies("How tall is the old tower? " * 20_000, "How tall is the old tower?")
    assert answer_defects.copies("Solar power?", "solar power") and answer_defects.copies("Why?", "Why?")
    assert not answer_defects.copies("Solar power works.", "Solar power?")


def test_answers_in_further_languages_and_in_the_assistants_name():
    assert answer_defects.defect_of("Which boat crossed the sea?", "De rode boot heeft de zee in mei met een bemanning van het eiland niet overgestoken.") == "other_language"
    assert answer_defects.defect_of("Which boat crossed the sea?", "La barca rossa non ha attraversato il mare, anche se è stata riparata nel porto della città.") == "other_language"
    assert answer_defects.defect_of("Welche Boote kamen?", "Dieser Assistent ist nicht befugt, das zu beantworten.") == "refusal"
    assert answer_defects.defect_of("Which boat?", "This assistant is not designed to answer such questions. Is there anything else?") == "refusal"
    quoted = "It was the red boat (de: \"" + "Das rote Boot der Stadt war es nicht und nie. " * 100 + "\") of the north of the bay."
    assert answer_defects.defect_of("Which boat crossed the sea?", quoted) is None


@pytest.mark.parametrize(
    ("answer", "stack"),
    [("All is well.", []), ("All is well", ["sentence"]), ("It is (as said", ["sentence", "("]), ("```\ncode", ["```"]), ("```\ncode\n```", []), ("So:\n- one\n- two", []), ("So:\n- one thing and the", ["sentence"]), ("774", []), ("See [1]", []), ("It is 3.5", ["sentence"]), ("Well...", ["sentence"]), ("He said \"no.\"", [])],
)
def test_pushdown_parser(answer, stack):
    assert answer_defects.open_at_end(answer) == stack


def test_defects_of_records(spark):
    rows = frame(spark, [("t", "1", "q", None), ("t", "1", "q", ""), ("t", None, "q", ""), ("t", "2", None, "All is well in the town.")], "record_table string, record_id string, question string, answer string")
    assert [tuple(r) for r in answer_defects.find_defects(rows).collect()] == [("t", "1", "empty_answer")]


def test_token_ids_equal_the_public_encoder(spark):
    import tiktoken

    ranks = token_ids.load_ranks(f"{token_ids.VOCABULARY_DIR}/byte_bpe_50k.tiktoken")
    public = tiktoken.Encoding("own", pat_str=token_ids.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["", None, " ", "<|endoftext|> x", "a" * 5000, LONG, *("".join(rng.choice(" \n\ta'sé中😀1-_b\u3000") for _ in range(rng.randint(1, 40))) for _ in range(300))]
    rows = frame(spark, list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    for r in token_ids.encode_corpus(rows).collect():
        assert r.ids == (None if texts[r.doc_id] is None else public.encode_ordinary(texts[r.doc_id]))
    assert base64 and token_ids.encode_corpus(rows.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 60)}"
    items = {i: [word() for _ in range(rng.randint(5, 40))] for i in range(40)}
    docs = {}
    for d in range(200):
        item = items[rng.randrange(40)]
        a = rng.randint(0, len(item) // 2)
        docs[d] = [word() for _ in range(rng.randint(0, 30))] + item[a : a + rng.randint(4, 40)] + [word() for _ in range(5)]

    def leaked(doc, item):
        grams = {tuple(doc[i : i + 8]) for i in range(len(doc) - 7)}
        hit = set()
        for i in range(len(item) - 7):
            if tuple(item[i : i + 8]) in grams:
                hit |= set(range(i, i + 8))
        return bool(hit) and 2 * len(hit) >= len(item)

    want = {(d, i) for d in docs for i in items if leaked(docs[d], items[i])}
    frames = frame(spark, [(d, " ".join(w)) for d, w in docs.items()] + [(900, None), (901, " ")], "doc_id bigint, text string"), frame(spark, [(i, " ".join(w).upper()) for i, w in items.items()] + [(99, None)], "item_id bigint, text string")
    assert {tuple(r) for r in leaked_items.find_leaks(*frames).collect()} == want and want
    assert leaked_items.find_leaks(frames[0], frames[1].limit(0)).count() == 0


def test_search_bait(spark):
    rng = random.Random(2)
    nouns = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    prose = lambda: ". ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} was in {rng.choice(nouns)} and it {rng.choice(nouns)} with {rng.choice(nouns)} for {rng.choice(nouns)}" for _ in range(12))
    rows = [(i, prose()) for i in range(120)]
    rows += [(900, ", ".join(rng.choice(["cheap", "best", "top"]) + " " + rng.choice(["tokens", "boats"]) for _ in range(90))), (901, "\n".join(f"[{rng.choice(nouns)}](http://{rng.choice(nouns)}.test/{i})" for i in range(60))), (902, prose() + "\n\n" + "cheap boats " * 12), (903, None), (904, "")]
    got = {r.doc_id for r in search_bait.find_bait(frame(spark, rows + rows[120:121], "doc_id bigint, text string")).collect()}
    assert got == {900, 901}
    short = [(910, "\n".join(f"http://{rng.choice(nouns)}.test/{rng.choice(nouns)}{i}" for i in range(11))), (911, " ".join("#" + rng.choice(nouns[:6]) + rng.choice(nouns[:2]) for _ in range(40))), (912, "best boats cheap boats top boats buy boats"), (913, "A short note of the town."), (914, "...")]
    assert {r.doc_id for r in search_bait.find_bait(frame(spark, rows + short, "doc_id bigint, text string")).collect()} >= {900, 901, 910, 911, 912}
    assert search_bait.find_bait(frame(spark, [], "doc_id bigint, text string")).count() == 0
