"""Problem 7: question and answer pairs that are unusable, with what is wrong with them.

Method: a pushdown parser reads an answer as fences, lists, bare values and paragraphs of sentences, with code spans, brackets, quotations
and emphasis inside; what is left on its stack at the end (a sentence without its stop, an open bracket or fence) breaks off. Greedy string
tiling says how much of an answer is the question again; script and function-word checks compare the languages; a small grammar per
language recognises refusals (a first person, or none at all, with a predicate of declining).

Order of defects, as a record has one at most: empty_answer, refusal, copies_question, other_language, truncated.

All checks look at one pair at a time, so the job is one narrow stage over the pairs; only found defects are shuffled, to give repeated
rows of a record one row.

Defined cases: a null or blank answer is empty_answer; a null or blank question can be neither copied nor differ in language; null
record ids are left out; whole texts are read, however long; a question of one or two words is copied only by an answer that says nothing
else; rows of one record that disagree give the first defect of the order above.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.word_lists import FUNCTION_WORDS, MORE_FUNCTION_WORDS

ORDER = ("empty_answer", "refusal", "copies_question", "other_language", "truncated")
TILE = 3
REST_WORDS = 6
VALUE_WORDS = 4

_NOTHING = re.compile(r"[\s​-‍⁠﻿­]*(?:\[\d+\]|[^\w])*[\s​-‍⁠﻿­]*")
#: Words that stand for no answer.
_NO_ANSWER = frozenset("n/a na none (none) null nil nan undefined tbd todo - empty (empty) keine keiner ninguno aucun aucune néant ninguna k.a. s/o s.o.".split()) - {"none.", "no"}
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?…\n]+(?:[.!?…]+(?=\s|$)|[.!?…]+|\n|$)")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‹[^›\n]*›")
_FENCED = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_ITEM = re.compile(r"\s*(?:[-*•+–‣]|\d{1,3}[.)]|[a-zA-Z][.)])\s+\S")
_CITED = re.compile(r"(?:\[\d{1,3}(?:\s*[,;-]\s*\d{1,3})*\]\s*)+[.!?]?\s*$")

#: What shows that an answer speaks of itself, by language.
_SELF = re.compile(r"\b(?:i|i'm|i'd|i'll|i've|me|my|we|we're|our|us|let's|ich|mich|mir|mein\w*|wir|uns|unser\w*|je|j|m|me|moi|mon|ma|mes|nous|notre|yo|mi|mis|puedo|prefiero|siento|debo|podemos|lamento|quiero|deseo|estoy|soy|doy|tengo|voy|assistant\w*|assistent\w*|asistente\w*|asistent\w*|chatbot|bot)\b(?![-–]\d)|\b(?:language|ai) model\b|sprachmodell|modèle de langage|modelo de lenguaje", re.I)
#: Predicates of declining, by language.
_DECLINE = re.compile(
    r"\b(?:can(?:no|')t|can not|could(?: not|n't)|unable|not able|not in a position|not (?:designed|intended|meant|made|built|authori[sz]ed|trained)|won't|will not|do(?:es)? not|don't|must not|may not|not (?:allowed?|permitted|comfortable|something|willing|supposed)|declin\w*|refus\w*|rather not|prefer not|remit|scope|guidelines?|polic(?:y|ies) (?:of|prevents?)|inappropriate|(?:am|are) (?:permitted|allowed) to|avoid|abstain|pass on|other than|something else|no (?:comment|advice|opinion))\b"
    r"|\b(?:nicht|kein\w*|schweige\w*|außerhalb|darf|unmöglich|enthalte|verweiger\w*|ablehn\w*|lehne|untersagt|verboten)\b"
    r"|\b(?:ne|n)\b.{0,40}\b(?:pas|rien|point|aucun\w*)\b|\b(?:interdit\w*|abstien\w*|refuse\w*|hors de|impossible|décline|dépasse)\b|\bpréf\w+ ne pas\b"
    r"|\bno (?:puedo|debo|podemos|deseo|quiero|me|es posible|doy|soy|estoy|tengo|voy|opinar|hablar|responder|se me)\b|\bprefiero no\b|\b(?:fuera de|abstengo|rechaz\w+|declin\w+|prohib\w+|imposible)\b",
    re.I,
)
#: Refusals that need no first person.
_BARE = re.compile(r"^\W*(?:no comment|kein kommentar|pas de commentaires?|sans commentaire|sin comentarios?|let'?s talk about something|not (?:something|a topic)|for safety reasons.{0,80}\bi\b)", re.I)
#: Sentences around a refusal that say nothing themselves.
_ASIDE = re.compile(
    r"^\W*(?:hello|hi|hey|hmm+|sorry|hallo|guten tag|bonjour|hola|pardon|désolée?|lo siento|entschuldigung|unfortunately|leider|malheureusement|lamentablemente|thank you|thanks|danke|merci|gracias|ok|okay|well)\W*$"
    r"|anything else|something else|help (?:you )?with|sonst (?:noch )?helfen|autre chose|algo más|feel free|ask (?:a|an|your|the)\b|specialist|contact (?:the|your)|consult (?:a|an|your)|wenden sie sich|fragen sie|adressez|consultez|consulte|contacte|diríjase|pregunte a|instead\W*$",
    re.I,
)
_CANNOT_ALONE = re.compile(r"^\W*(?:i'?m |i am |we are |es tut mir |tut mir |je suis |lo )?(?:so |very |really )?(?:sorry|leid|désolée?|siento)\W*$", re.I)


def says_nothing(answer: str | None) -> bool:
    """Null, blank, only signs and citation markers, or a word that stands for no answer."""
    if answer is None:
        return True
    text = answer.strip()
    return bool(_NOTHING.fullmatch(text)) or text.strip("​﻿  .").lower() in _NO_ANSWER


def is_refusal(answer: str) -> bool:
    """Whether every sentence that says something declines to answer."""
    text = answer.replace("’", "'")
    declined = False
    for sentence in (m.group().strip() for m in _SENTENCE.finditer(text)):
        if not _WORD.search(sentence):
            continue
        if _BARE.search(sentence) or (_SELF.search(sentence) and _DECLINE.search(sentence)) or re.search(r"\btopic i avoid\b|\bbeyond my\b|\boutside (?:of )?my\b|\bagainst my\b", sentence, re.I):
            declined = True
        elif not (_ASIDE.search(sentence) or _CANNOT_ALONE.search(sentence)):
            return False
    return declined


def tiled(answer: list[str], question: list[str], least: int = TILE) -> tuple[int, int]:
    """Words of the answer and of the question that lie in tiles of the greedy string tiling (longest common stretches first).

    The question may be used again once it is used up, as a copied question may be repeated.
    """
    covered = [False] * len(answer)
    used: set[int] = set()
    places: dict[str, list[int]] = {}
    for at, word in enumerate(question):
        places.setdefault(word, []).append(at)
    longest, after = [0] * len(answer), {}
    for a in range(len(answer) - 1, -1, -1):
        after = {q: 1 + after.get(q + 1, 0) for q in places.get(answer[a], ())}
        longest[a] = max(after.values(), default=0)
    enough = max(1, min(least, len(question)))
    waiting = [(-size, a) for a, size in enumerate(longest) if size >= enough]
    heapify(waiting)
    starts: list[int] = []
    while waiting:
        size, a = -waiting[0][0], heappop(waiting)[1]
        if covered[a]:
            continue
        near = bisect_left(starts, a)
        free = min(size, starts[near] - a) if near < len(starts) else size
        if free < size:  # a tile laid since then cuts this stretch short
            if free >= enough:
                heappush(waiting, (-free, a))
            continue
        q = next(q for q in places[answer[a]] if answer[a : a + size] == question[q : q + size])
        covered[a : a + size] = [True] * size
        insort(starts, a)
        used.update(range(q, q + size))
    return sum(covered), len(used)


def copies(answer: str, question: str | None) -> bool:
    """Whether the answer is the question again, with no more than a lead-in of a few words."""
    asked = [w.lower() for w in _WORD.findall(question or "")]
    said = [w.lower() for w in _WORD.findall(answer)]
    most, known = min(REST_WORDS, max(2, len(asked) // 2)) if len(asked) >= TILE else 0, set(asked)
    if not asked or not said or sum(w not in known for w in said) > most:
        return False  # words the question doesn't have lie in no tile
    inside, used = tiled(said, asked)
    return inside >= 0.5 * len(said) and len(said) - inside <= most and used >= 0.6 * len(asked)


def _script(text: str) -> str:
    """The script most letters belong to, among those that exclude one another."""
    counts = {"latin": 0, "cyrillic": 0, "greek": 0, "arabic": 0, "hebrew": 0, "cjk": 0, "other": 0}
    for letter, times in Counter(text).items():
        if letter.isalpha():
            code = ord(letter)
            name = "latin" if code < 0x250 or 0x1E00 <= code < 0x1F00 else "greek" if code < 0x400 else "cyrillic" if code < 0x530 else "hebrew" if 0x590 <= code < 0x600 else "arabic" if 0x600 <= code < 0x780 else "cjk" if 0x3040 <= code < 0xD7B0 else "other"
            counts[name] += times
    return max(counts, key=lambda x: counts[x]) if any(counts.values()) else ""


_VOTES: dict[str, list[str]] = {}
for _name, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _VOTES.setdefault(_w, []).append(_name)
_MORE: dict[str, list[str]] = {}
for _name, _set in MORE_FUNCTION_WORDS.items():
    for _w in _set - _VOTES.keys():
        _MORE.setdefault(_w, []).append(_name)
_HINTS = {"de": re.compile(r"[äöß]|ü(?!e)"), "es": re.compile(r"[ñ¿¡]|ción\b"), "fr": re.compile(r"[çèêœ]|\b(?:l|d|qu|n|s)['’]")}


def votes(text: str) -> dict[str, float]:
    """Points for each language: function words (shared ones split) and letters only one of the languages has."""
    points = dict.fromkeys(FUNCTION_WORDS, 0.0)
    low = text.lower()
    for word in _WORD.findall(low):
        names = _VOTES.get(word)
        if names:
            for name in names:
                points[name] += 1.0 / len(names)
    for name, hint in _HINTS.items():
        points[name] += 0.5 * len(hint.findall(low))
    return points


def foreign_words(text: str) -> int:
    """The most words of one further language that none of the main ones has."""
    held = Counter(name for word in _WORD.findall(text.lower()) for name in _MORE.get(word, ()))
    return max(held.values(), default=0)


def _leader(points: dict[str, float], least: float, lead: float) -> str | None:
    ordered = sorted(points.items(), key=lambda x: -x[1])
    return ordered[0][0] if ordered[0][1] >= least and ordered[0][1] >= lead * max(ordered[1][1], 0.01) else None


def differs_in_language(answer: str, question: str | None) -> bool:
    """Whether the answer, quotations and code aside, is in another language than the question."""
    if not question or not question.strip():
        return False
    said = _QUOTED.sub(" ", _FENCED.sub(" ", answer))
    if sum(times for letter, times in Counter(said).items() if letter.isalpha()) < 12:
        return False
    scripts = _script(question), _script(said)
    if scripts[0] and scripts[1] and scripts[0] != scripts[1] and len(_WORD.findall(said)) >= 2:
        return True
    asked, own = votes(question), votes(said)
    ask, say = _leader(asked, 1.0, 1.25), _leader(own, 2.0, 1.4)
    if ask and (more := foreign_words(said)) >= 3 and more > 1.4 * own[ask] and not foreign_words(question):
        return True
    if not ask or not say or ask == say:
        return False
    sentences = [s for s in _SENTENCE.findall(said) if len(_WORD.findall(s)) >= 4]
    foreign = [s for s in sentences if (p := _leader(votes(s), 1.0, 1.0)) and p != ask]
    return len(foreign) * 2 > len(sentences) if sentences else True


#: Function words an item or a sentence can't end with.
_DANGLING = frozenset(w for words in FUNCTION_WORDS.values() for w in words) - frozenset("on in from at by is are was were all it its not out up be had has have did one their there these those so more no can could will would".split()) | {"the", "and", "an", "a"}


_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_OPENS = {"(": "(", "[": "[", "{": "{", "“": "“", "«": "«", "„": "“"}
_STOPS = frozenset(".!?。！？")
#: What the parser looks at: words and signs.
_PARTS = re.compile(r"\*\*|\.\.\.|[^\W_]+|[`(\[{“«„)\]}”»\"<….!?。！？]")
_CUT_TAG = re.compile(r"<[a-z/!][^<>]*$", re.I)
#: A value: figures with their signs and a unit.
_FIGURE = re.compile(r"[\W\d]*\d[\d.,:/ -]*\s*[^\W\d]{0,12}[%€$]?")


def is_value(text: str) -> bool:
    """Whether a line is a bare value: figures, one word with figures, or a few words none of which is a function word."""
    words = text.split()
    if len(words) == 1 and any(c.isdigit() for c in text):
        return True
    if len(words) <= VALUE_WORDS and text[-1:].isalnum() and not _leader(votes(text), 1.0, 1.0):
        return True
    return bool(_FIGURE.fullmatch(text))


def open_at_end(text: str) -> list[str]:
    """The stack of the pushdown parser after the text: fences, code spans, brackets, quotations, emphasis, items and sentences still open.

    A letter or figure outside code opens a sentence, a stop closes it and whatever follows a citation marker is closed with it; three stops
    leave it open. The end of an item's line closes the item unless its last word asks for more; a blank line closes brackets and straight
    quotations that no later sign closes; a line that is a bare value is no sentence if it is all there is; within a fence nothing opens.
    """
    stack: list[str] = []
    lines = text.split("\n")
    for number, line in enumerate(lines):
        bare, last = line.strip(), number == len(lines) - 1
        if bare.startswith("```") and bare.count("```") == 1:
            stack = stack[:-1] if stack and stack[-1] == "```" else ["```"]
            continue
        if stack and stack[-1] == "```":
            if bare.endswith("```"):
                stack.pop()
            continue
        if not bare:
            stack = []
            continue
        item = _ITEM.match(line)
        if item and (number or not last):
            stack = [s for s in stack if s != "sentence"]
        at = item.end() - 1 if item else 0
        value = len(lines) == 1 and is_value(bare)
        for part in _PARTS.finditer(line, at):
            sign, after = part.group(), part.end()
            if stack and stack[-1] == "`":
                if sign == "`":
                    stack.pop()
            elif sign == "`":
                stack.append("`")
            elif sign in _OPENS:
                stack.append(_OPENS[sign])
            elif sign in _PAIRS:
                _close(stack, _PAIRS[sign])
            elif sign == '"':
                if '"' in stack:
                    _close(stack, '"')
                else:
                    stack.append('"')
            elif sign == "**":
                if "**" in stack:
                    _close(stack, "**")
                elif after < len(line) and not line[after].isspace():
                    stack.append("**")
            elif sign == "<":
                if last and _CUT_TAG.match(line, part.start()):
                    stack.append("<")
            elif sign in ("…", "..."):
                if "sentence" not in stack:
                    stack.append("sentence")
            elif sign in _STOPS:
                if not line[after : after + 1].isalnum():
                    _close(stack, "sentence", also=False)
            elif "sentence" not in stack and not value:
                stack.append("sentence")
        if last and (_CITED.search(line) or (line.rstrip().endswith("`") and "`" not in stack)):
            _close(stack, "sentence", also=False)
        if item and (number or not last):
            words = _WORD.findall(line.lower())
            if not (last and len(words) > 3 and line[-1:].isalpha() and words[-1] in _DANGLING):
                _close(stack, "sentence", also=False)
    return stack


def _close(stack: list[str], name: str, also: bool = True) -> None:
    """Takes the last ``name`` off the stack, and with ``also`` what was opened inside it, a sentence aside."""
    if name not in stack:
        return
    at = len(stack) - 1 - stack[::-1].index(name)
    inside = stack[at + 1 :] if not also else [s for s in stack[at + 1 :] if s == "sentence"]
    stack[at:] = inside


def breaks_off(answer: str) -> bool:
    """Whether the answer ends before its end: something that has to be closed is still open, straight quotations and emphasis aside."""
    text = answer.rstrip().rstrip("\u200b\ufeff")
    stack = open_at_end(text)
    if text.endswith("```"):
        return "```" in stack
    return any(s in "([{<" or s in ("```", "sentence") for s in stack)


def defect_of(question: str | None, answer: str | None) -> str | None:
    """The defect of one pair, or None."""
    if says_nothing(answer):
        return "empty_answer"
    if is_refusal(answer):
        return "refusal"
    if copies(answer, question):
        return "copies_question"
    if differs_in_language(answer, question):
        return "other_language"
    return "truncated" if breaks_off(answer) else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        found = [defect_of(q, a) for q, a in zip(columns[2], columns[3], strict=True)]
        keep = pa.array([i for i, d in enumerate(found) if d], pa.int64())
        order = pa.array([ORDER.index(d) for d in found if d], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), order], ["record_table", "record_id", "place"])


def find_defects(pairs: DataFrame) -> DataFrame:
    """(record_table, record_id, defect) of the defective pairs; ``pairs``: record_table, record_id, question, answer, all STRING."""
    rows = pairs.select("record_table", "record_id", "question", "answer").where("record_id is not null")
    found = rows.mapInArrow(_judge, "record_table string, record_id string, place int").groupBy("record_table", "record_id").agg(F.min("place").alias("place"))
    return found.select("record_table", "record_id", F.element_at(F.array(*map(F.lit, ORDER)), F.col("place") + 1).alias("defect"))


def question_answer_pairs(responses: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs to judge: responses but those with insufficient evidence, and items but those that need no answer and have none."""
    chat = responses.where(F.coalesce(F.lower("confidence"), F.lit("")) != "insufficient evidence").select(F.lit("chat_responses").alias("record_table"), F.col("query_id").cast("string").alias("record_id"), "question", "answer")
    needed = (F.coalesce(F.size("evidence"), F.lit(0)) > 0) | F.coalesce(F.col("reference_answer").rlike(r"\S"), F.lit(False))
    qa = items.where(needed).select(F.lit("qa_items").alias("record_table"), F.col("id").alias("record_id"), "question", F.col("reference_answer").alias("answer"))
    return chat.unionByName(qa)
