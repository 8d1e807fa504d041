"""Text expressions on columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no search meaning.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both "
    "but by can could did do does doing down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on "
    "once only or other our ours ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which "
    "while who whom why will with would you your yours yourself yourselves tell show give explain describe please "
    "document documents doc file says say mention mentions"
).split()
#: Words left out when answers are compared with their context.
JUDGE_STOP_WORDS = (
    "a an the and or but if then else of to in on at by for with from into onto about as is are was were be "
    "been being it its this that these those there here which who whom whose what when where why how not no nor so than too "
    "very can could should would may might must shall will do does did done has have had having i you he she we they them "
    "their our your his her my me us also just only such any all each every some most more other own same both either neither "
    "one per via etc e g ie"
).split()
TOKEN = r"[a-z0-9]+(?:[.'][a-z0-9]+)*"
#: File extensions and the parser that reads them.
PARSERS = {"pdf": "pdf", "docx": "docx", "html": "html", "htm": "html", "txt": "txt", "md": "txt", "markdown": "txt", "rst": "txt", "log": "txt", "py": "txt", "json": "json", "csv": "csv"}
NOT_FOUND = "I couldn't find this in the uploaded documents."
#: Phrases by which an answer says that nothing was found.
NOT_FOUND_MARKS = ("i couldn't find this in the uploaded documents", "couldn't find this in the uploaded documents", "could not find this in the uploaded documents", "insufficient evidence", "do not contain sufficient")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where it stands in a lambda or several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extension(name: Column) -> Column:
    """The lower-case extension without its dot; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"[^./\\]\.([A-Za-z0-9]+)$", 1))


def file_type(name: Column) -> Column:
    kind = F.lit("txt")
    for ext, parser in PARSERS.items():
        kind = F.when(extension(name) == ext, F.lit(parser)).otherwise(kind)
    return kind


def is_supported(name: Column) -> Column:
    return extension(name).isin(*PARSERS)


def content_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def clean(text: Column) -> Column:
    """Unified line ends, no invisible characters, no page marker lines, short dot leaders and blanks."""
    # The patterns of this and the next function.
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, " ", " "), "­", "")
    out = F.regexp_replace(out, "[​-‍⁠﻿]", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    out = F.regexp_replace(out, r"(?imd)^\s*(?:[-=_]{2,}\s*)?(?:page\s+\d+(?:\s+of\s+\d+)?|\d+\s+of\s+\d+|-\s*\d+\s*-)(?:\s*[-=_]{2,})?\s*$", "")
    out = F.regexp_replace(out, r"(?:\.\s*){5,}", "... ")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"[ \t]+\n", "\n")
    return F.coalesce(strip(F.regexp_replace(out, r"\n{3,}", "\n\n")), F.lit(""))


def join_wrapped_lines(text: Column) -> Column:
    """Words hyphenated across lines rejoined, and softly wrapped lines joined."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z])-\n([a-z])", "$1$2"), r"([A-Za-z0-9,'\")])[ \t]*\n(?=[a-z(])", "$1 ")


def squeeze(text: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(strip(F.regexp_replace(text, r"\s+", " ")))


def stem(token: Column) -> Column:
    size = F.length(token)
    return F.when((size > 4) & token.endswith("ies"), F.concat(token.substr(F.lit(1), size - 3), F.lit("y"))).when((size > 3) & token.endswith("s") & ~token.rlike("(?:ss|us|is)$"), token.substr(F.lit(1), size - 1)).otherwise(token)


def tokens(text: Column) -> Column:
    """Search tokens: ASCII words without stop words and single letters, lightly stemmed, in order."""
    # The pattern of a token and the rules of ``stem``.
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    kept = F.filter(found, lambda t: ~t.isin(*STOP_WORDS) & ((F.length(t) > 1) | t.rlike("^[0-9]$")))
    return F.transform(kept, stem)


def content_words(text: Column) -> Column:
    """The distinct words that say something, for comparing an answer with its context."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*JUDGE_STOP_WORDS) & ((F.length(w) > 2) | w.rlike("^[0-9]+$"))))


def sentences(text: Column) -> Column:
    """Sentences that end at a line break or at end marks before a capital, digit, quote or bracket."""
    # The patterns of the ends of sentences, here and in ``sentence_spans``.
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\n\s*", "\x01")
    marked = F.regexp_replace(marked, r"([.!?;:])[ \t]+([\"'(\[A-Z0-9])", "$1\x01$2")
    return F.filter(F.transform(F.split(marked, "\x01"), strip), lambda s: s != "")


def sentence_spans(text: Column) -> Column:
    """Sentences that end at a blank line or at ``.!?``; single line breaks stay inside."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n\s*\n", "\x02")
    marked = F.regexp_replace(marked, r"([.!?])\s+([A-Z0-9\"'(\[`*])", "$1\x02$2")
    return F.filter(F.transform(F.split(marked, "\x02"), strip), lambda s: s != "")


def heading_level(line: Column) -> Column:
    """The level of a line that is a heading (``#`` lines, short lines in capitals: 2), else null."""
    bare = strip(line)
    marks = F.length(F.regexp_extract(bare, r"^(#{1,6})\s+\S", 1))
    capitals = F.length(bare).between(3, 80) & (F.upper(bare) == bare) & (F.lower(bare) != bare) & (F.size(F.split(bare, r"\s+")) <= 10) & bare.rlike("[A-Z]{3}") & ~bare.rlike("[.,;]$")
    return F.when(marks > 0, marks).when(capitals, F.lit(2))


def heading_title(line: Column) -> Column:
    bare = strip(line)
    return F.when(bare.rlike(r"^#{1,6}\s+\S"), F.regexp_replace(F.regexp_replace(bare, r"^#{1,6}\s+", ""), r"\s*#*\s*$", "")).otherwise(bare)


def coverage(query_terms: Column, text_terms: Column) -> Column:
    """The share of the distinct query terms that the text has."""
    return let(F.array_distinct(query_terms), lambda asked: F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, text_terms)) / F.size(asked)).otherwise(F.lit(0.0)))


def trigrams(text: Column) -> Column:
    """The distinct three-word runs of a text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def runs(words: Column) -> Column:
        three = lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))
        return F.when(F.size(words) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 2), three))).otherwise(F.array().cast("array<string>"))

    return let(found, runs)


def span_coverage(span: Column, text: Column) -> Column:
    """1 where the text contains the span (case and white space aside), else the share of its three-word runs found."""
    share = let(trigrams(span), lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, trigrams(text))) / F.size(own)).otherwise(F.lit(0.0)))
    return F.when(F.contains(squeeze(text), squeeze(span)), F.lit(1.0)).otherwise(share)


def estimated_tokens(text: Column) -> Column:
    size = F.coalesce(F.length(text), F.lit(0))
    return F.when(size == 0, F.lit(0)).otherwise(F.floor((size + 3) / 4)).cast("int")


def search_text(filename: Column, section: Column, text: Column) -> Column:
    return F.concat(F.concat_ws(" | ", filename, F.when(section != "General", section)), F.lit("\n"), text)


def is_not_found(answer: Column) -> Column:
    head = F.translate(F.lower(strip(F.coalesce(answer, F.lit("")))).substr(1, 300), "’", "'")
    out = F.lit(False)
    for mark in NOT_FOUND_MARKS:
        out = out | F.contains(head, F.lit(mark))
    return out


def cited_numbers(answer: Column) -> Column:
    """The distinct source numbers an answer cites, ascending."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,3}(?:\s*[,;]\s*\d{1,3})*)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*[,;]\s*"), lambda n: n.cast("int"))))))


def normal_markers(answer: Column, sources: Column) -> Column:
    """Citation markers one number each, without those of no source; a marker that loses all its numbers goes with the blank before it."""
    marker = r"[ \t]?\[\d{1,3}(?:\s*[,;]\s*\d{1,3})*\]"
    text = F.coalesce(answer, F.lit(""))

    def rewritten(found: Column) -> Column:
        numbers = F.filter(F.regexp_extract_all(found, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int").between(F.lit(1), sources))
        shown = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n, F.lit("]"))), "")
        return F.when(F.size(numbers) == 0, F.lit("")).otherwise(F.concat(F.regexp_extract(found, r"^[ \t]?", 0), shown))

    parts = F.split(F.regexp_replace(text, marker, "\x01"), "\x01", -1)
    shown = F.transform(F.regexp_extract_all(text, F.lit(marker), F.lit(0)), rewritten)
    return F.array_join(F.flatten(F.zip_with(parts, F.concat(shown, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def is_summary_request(question: Column) -> Column:
    # What asks for a summary, and the words that add nothing to it.
    asks = r"(?i)\b(summari[sz]e|summary|overview|tl;?dr|gist|main (?:points?|ideas?|takeaways?)|key (?:points?|takeaways?)|what(?:'s| is) (?:this|the|it) (?:\w+ )?about)\b"
    generic = ("report", "paper", "pdf", "book", "text", "article", "entire", "whole", "all", "main", "key", "point", "uploaded", "content", "contents", "brief", "short", "quick", "about", "doc")
    rest = F.filter(tokens(F.regexp_replace(question, asks, " ")), lambda t: ~t.isin(*generic))
    return F.coalesce(question.rlike(asks) & (F.size(rest) == 0), F.lit(False))


def error_message(status: Column, text: Column) -> Column:
    """What to tell a user about a failed model call."""
    # The marks of each kind of failure and its message.
    up = F.upper(F.coalesce(text, F.lit("")))
    has = lambda *marks: up.rlike("|".join(marks))
    return (
        F.when((status == 429) | has("RESOURCE_EXHAUSTED", "QUOTA"), "API quota or rate limit exceeded")
        .when(status.isin(401, 403) | has("API_KEY_INVALID", "API KEY NOT VALID", "PERMISSION_DENIED"), "API key was rejected (check that it is valid)")
        .when((status == 404) | has("NOT_FOUND"), "model not found (check the configured model name)")
        .when(status.isin(500, 502, 503, 504) | has("UNAVAILABLE"), "the AI service is temporarily unavailable")
        .when(has("TIMEOUT", "TIMED OUT"), "the request to the AI service timed out")
        .when(has("CONNECT", "NAME RESOLUTION", "NETWORK"), "could not connect to the AI service")
        .otherwise("request failed")
    )
