"""Plug points for models: clients with retries, pair scorers, query rewriting, judging. None has a default, as none is installed here."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is worth another try, and for how long.
RETRIED_CODES = frozenset((408, 429, 500, 502, 503, 504))
RETRIED_MARKS = ("RESOURCE_EXHAUSTED", "UNAVAILABLE", "TIMED OUT", "TIMEOUT")
ATTEMPTS, LONGEST_PAUSE = 4, 16.0
MOST_QUERIES = 4


def worth_another_try(problem: BaseException) -> bool:
    status = getattr(problem, "code", None) or getattr(problem, "status_code", None) or getattr(getattr(problem, "response", None), "status_code", None)
    return status in RETRIED_CODES or any(mark in str(problem).upper() for mark in RETRIED_MARKS)


def pauses(problem: BaseException, attempt: int) -> float:
    """Seconds before the next try: what the server asks for, else twice as long each time."""
    asked = re.search(r"retry(?:Delay|[- ]after)\D{0,10}(\d+(?:\.\d+)?)", str(problem), re.I)
    return float(asked[1]) + 0.5 if asked else min(2.0**attempt, LONGEST_PAUSE)


def with_retries(call: Callable, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried up to four times while its failures may pass, waiting no longer than ``longest`` seconds in all."""

    def run(*args, **named):
        left = longest
        for attempt in range(ATTEMPTS):
            try:
                return call(*args, **named)
            except Exception as problem:  # noqa: BLE001 - any client raises its own kinds
                pause = pauses(problem, attempt)
                if attempt + 1 == ATTEMPTS or not worth_another_try(problem) or pause > left:
                    raise
                left -= pause
                sleep(pause)

    return run


def generated(generate: Callable[[str], str], prompt: Column) -> Column:
    """STRUCT<text, error> of a model's answer to each prompt, by Arrow batches; a failure is this row's only."""

    @F.pandas_udf("struct<text:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = with_retries(generate)
        for prompts in batches:
            texts, errors = [], []
            for one in prompts:
                try:
                    texts.append(call(one))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001
                    texts.append(None)
                    errors.append(str(problem)[:300])
            yield pd.DataFrame({"text": texts, "error": errors})

    return run(prompt)


def rewritten(reply: str | None, question: str) -> list[str]:
    """The searches a model's reply asks for: its standalone question, the question, then other phrasings; the question alone where it can't
    be read."""
    asked = question.strip()
    try:
        held = json.loads(re.search(r"\{.*\}", reply or "", re.S)[0])
        standalone = held.get("standalone")
        every = [standalone if isinstance(standalone, str) and standalone.strip() else asked, asked, *(held.get("queries") or [])]
    except (TypeError, ValueError, AttributeError):
        return [asked]
    kept: dict[str, str] = {}
    for search in every:
        if isinstance(search, str) and search.strip():
            kept.setdefault(search.strip().lower(), search.strip())
    return [*kept.values()][:MOST_QUERIES]


def rewrites(generate: Callable[[str], str] | None, prompt: Column, question: Column) -> Column:
    """ARRAY<STRING> of searches for each question; without a model, or where it fails, the question itself."""
    if generate is None:
        return F.array(F.trim(question))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        call = with_retries(generate)

        def one(text: str, asked: str) -> list[str]:
            try:
                return rewritten(call(text), asked)
            except Exception:  # noqa: BLE001
                return [asked.strip()]

        for prompts, questions in batches:
            yield pd.Series([one(p, q) for p, q in zip(prompts, questions, strict=True)])

    return run(prompt, question)


def pair_scores(score: Callable[[list[tuple[str, str]]], list[float]], question: Column, text: Column, batch: int = 32) -> Column:
    """DOUBLE score of each (question, text), null for all of a batch whose scoring failed."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            pairs, out = list(zip(questions, texts.fillna(""), strict=True)), []
            for first in range(0, len(pairs), batch):
                part = pairs[first : first + batch]
                try:
                    out += [float(x) for x in score(part)]
                except Exception:  # noqa: BLE001
                    out += [None] * len(part)
            yield pd.Series(out, dtype="float64")

    return run(question, text)


def judged(generate: Callable[[str], str], prompt: Column) -> Column:
    """DOUBLE verdict 1, 0.5 or 0 of a judging model, null where it gives none."""
    reply = generated(generate, prompt)["text"]
    return F.regexp_extract(reply, r"(?s)\"?verdict\"?\s*:\s*\"?(1(?:\.0)?|0?\.5|0(?:\.0)?)", 1).try_cast("double")
