"""Problem 6: the lines of a web page that belong to the site around its article.

Method: tag-path ratios. The pages come as lines of text, so a line's path runs from the page over its region (before the first sentence,
between sentences, after the last), its block (plain, or under a line that usually opens lists of links) and its reach (with a sentence before the next
wall, or without) to its leaf (sentence, heading, item, separated row, or how common the pieces of text are that it shares with other pages). Text length,
punctuation and the nearness of sentences are summed per path, over all pages of a site and over all sites; the two are fused, smoothed
along the page and thresholded, so a line is content if its path is. No word list decides: which pieces of text are widgets, menus or
notices is read off the corpus.

A piece is a whole line, a cell of a separated row, what stands before a colon, the first or last sentence of a line, or the form of a line
with signs or figures and its first two words. Its rate is the share of its language's pages with it, counted once for each pair of sentences around it, so that
copies of a page, edited ones too, don't make its headings common. Headings come back by chance, the more the fewer nouns a language's
pages have: the rates of pieces that mostly lead into sentences tell how often, and other lines are common only beside that level. Text adds to a path's ratio by
how rare its pieces are.

Pieces on at least ``RARE`` of a language's pages go to the driver and to all tasks. The rates of all pieces of a language sum to the pieces of
a mean page, so there are at most (pieces of a mean page) / ``RARE`` of them, however large the corpus. Sums per piece and per (site, path)
have map-side combine; lines are joined with their site's ratios in ``SALTS`` parts, so a site that holds a third of all pages is spread.
Lines travel without their text.

Defined cases: rows without an origin, and null or blank texts, give nothing; lines are split at line feeds and counted from 1 with
blank ones; blank lines are never returned; a page sent twice counts once; other columns are ignored; a corpus of a page or two has no
common pieces, so there only lines far from sentences are left out; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.word_lists import FUNCTION_WORDS
from docloom.session import cut_lineage

THRESHOLD = 0.3
#: Share of a language's pages from which a piece is looked at.
RARE = 0.001
#: Rates at which text counts half: pieces of sentences and rows, lead-ins before a colon, forms and beginnings of lines.
COMMON = {"s": 0.0015, "c": 0.008, "g": 0.02}
#: For headings and items: that share of the level below which chance keeps nearly all of them, and the least it can be.
CHANCE_SHARE, LEAST_LEVEL = 0.32, 0.003
#: Pages a piece may be on by chance.
CHANCE = 1.5
#: Share of a piece's occurrences with a list right below, from which lines below it are its block.
OPENS = 0.55
SALTS = 16
_MARK = re.compile(r"^\s*(?:[-*•›»+–▪‣]|\d{1,2}[.)])\s+")
_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?…][\"'”’»)]?\s*$")
_CELLS = re.compile(r"\s+[|·•>»/]\s+|\s{2,}")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_FIGURES = re.compile(r"\d+")
_LANGUAGES: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words:
        _LANGUAGES.setdefault(_word, []).append(_language)


def language_of(text: str) -> str:
    """The language most function words of a text belong to, "none" without any."""
    counts: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for language in _LANGUAGES.get(word, ()):
            counts[language] += n
    return max(sorted(counts), key=lambda x: counts[x]) if counts else "none"


def shape_of(line: str) -> str:
    """The form of a non-blank line: sentence, row, item, heading, or signs."""
    text = line.strip()
    bare = _MARK.sub("", text).strip()
    words = _WORD.findall(bare)
    if not words:
        return "signs"
    if len(words) >= 4 and len(bare) >= 25 and _STOP.search(bare):
        return "sentence"
    if len(_CELLS.split(bare)) > 1:
        return "row"
    if len(words) > 14:
        return "sentence"
    return "item" if bare != text else "heading"


def pieces_of(line: str, shape: str) -> list[str]:
    """The pieces of a non-blank line that may stand on many pages, each led by its sort: the line itself first."""
    text = " ".join(_FIGURES.sub("0", _MARK.sub("", line.strip())).lower().split())
    if shape == "sentence":
        parts = _SENTENCES.split(text)
        return list(dict.fromkeys("s" + p for p in (text, parts[0], parts[-1])))
    out = ["e" + text]
    cells = [c.strip() for c in _CELLS.split(_FIGURES.sub("0", line.strip()).lower())]
    if len(cells) > 1:
        out += ["e" + _MARK.sub("", c) for c in cells if _WORD.search(c)]
    head, colon, _ = text.partition(":")
    if colon:
        out.append("c" + head)
    out += ["s" + p for p in _SENTENCES.split(text)[1:]]
    form = re.sub(r"(\W+w)\1+", r"\1+", re.sub(r"[^\W\d_]+", "w", text))
    if form.strip("w +"):
        out.append("g" + form)
    out.append("g" + " ".join(text.split(" ")[:2]) + " ...")
    return list(dict.fromkeys(out))


def _signature(shapes: list[str], lines: list[str], at: int) -> int:
    """A number for the sentences next to a line on either side: the same in copies of a page."""
    import xxhash

    before = next((lines[i] for i in range(at - 1, -1, -1) if shapes[i] == "sentence"), "")
    after = next((lines[i] for i in range(at + 1, len(lines)) if shapes[i] == "sentence"), "")
    return xxhash.xxh64_intdigest(f"{before.strip()}\n{after.strip()}") - (1 << 63)


def _code(piece: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(piece) - (1 << 63)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for text in batch.column(2).to_pylist():
            lines = text.split("\n")
            shapes = [shape_of(x) if x.strip() else "" for x in lines]
            language = language_of(text)
            seen: set[str] = set()
            for at, shape in enumerate(shapes):
                fresh = [p for p in pieces_of(lines[at], shape) if p not in seen] if shape else []
                if not fresh:
                    continue
                seen.update(fresh)
                row = (_signature(shapes, lines, at), float(leads_list(shapes, at)), float(leads_on(shapes, at)))
                for piece in fresh:
                    for column, value in zip(out, (language, piece[0], _code(piece), *row), strict=True):
                        column.append(value)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["lang", "sort", "piece", "signature", "listed", "leads"])


def leads_on(shapes: list[str], at: int) -> bool:
    """Whether a line, or the headings and items that follow it at once, lead into a sentence."""
    here = at + 1
    while here < len(shapes) and shapes[here] in ("item", "heading"):
        here += 1
    return here < len(shapes) and shapes[here] == "sentence"


def leads_list(shapes: list[str], at: int) -> bool:
    """Whether lines of headings or items follow at once and don't lead into a sentence."""
    here = at + 1
    while here < len(shapes) and not shapes[here]:
        here += 1
    first = here
    while here < len(shapes) and shapes[here] in ("item", "heading"):
        here += 1
    many = here - first
    while many == 1 and here < len(shapes) and not shapes[here]:
        here += 1
    return many > 1 or (many == 1 and not (here < len(shapes) and shapes[here] == "sentence"))


def paths(text: str, common: dict[int, tuple[float, float]]) -> list[tuple[int, str, float]]:
    """(line number, path, value it adds to its path) of each non-blank line; ``common``: how common a piece is and how often a list is right below."""
    lines = text.split("\n")
    shapes = [shape_of(x) if x.strip() else "" for x in lines]
    rare, opens = [1.0] * len(lines), [False] * len(lines)
    for at, shape in enumerate(shapes):
        if shape:
            held = [common.get(_code(p), (0.0, 0.0)) for p in pieces_of(lines[at], shape)]
            rare[at] = 1.0 / (1.0 + max(x for x, _ in held) ** 2)
            opens[at] = held[0][0] >= 1 and held[0][1] >= OPENS
    sentences = [i for i, s in enumerate(shapes) if s == "sentence" and rare[i] >= 0.5]
    first, last = (sentences[0], sentences[-1]) if sentences else (len(lines), -1)
    under = _under(shapes, rare, opens)
    walls = [rare[i] < 0.5 or under[i] or shapes[i] in ("row", "signs") for i in range(len(lines))]
    below, above = _distances(shapes, walls, 1), _distances(shapes, walls, -1)
    out = []
    for at, shape in enumerate(shapes):
        if not shape:
            continue
        size = min(len(lines[at].strip()) / 80, 1.0)
        near = 0.0 if walls[at] else max(below[at], above[at])
        own = (0.2 * size + 0.25 * float(bool(_STOP.search(lines[at]))) + 0.55 * near) * rare[at]
        region = "head" if at < first else "foot" if at > last else "body"
        leaf = f"common{min(9, int(10 * (1 - rare[at])))}" if rare[at] < 0.9 else shape
        reach = "near" if near > 0 else "far"
        out.append((at + 1, f"{region}/{'under' if under[at] else 'plain'}/{reach}/{leaf}", own))
    return out


def _under(shapes: list[str], rare: list[float], opens: list[bool]) -> list[bool]:
    """The lines in the block of a line that opens lists: up to a blank line, a sentence, or the heading of one."""
    out, inside, begun = [False] * len(shapes), False, False
    for at, shape in enumerate(shapes):
        if not shape:
            inside = inside and not begun
        elif opens[at]:
            inside, begun = True, False
        elif inside:
            heads_text = shape == "heading" and not begun and at + 1 < len(shapes) and shapes[at + 1] == "sentence"
            inside = shape in ("item", "heading") and rare[at] >= 0.5 and not heads_text
            out[at], begun = inside, True
    return out


def _distances(shapes: list[str], walls: list[bool], step: int) -> list[float]:
    """For each line 1 at a sentence, less with every heading or item up to the next sentence, 0 where a wall comes first."""
    out, value = [0.0] * len(shapes), 0.0
    order = range(len(shapes) - 1, -1, -1) if step > 0 else range(len(shapes))
    for at in order:
        if shapes[at]:
            value = 0.0 if walls[at] else 1.0 if shapes[at] == "sentence" else value * 0.98
        out[at] = value
    return out


def _paths_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates = shared.value
        for batch in batches:
            docs, sites, numbers, names, values = [], [], [], [], []
            for doc, site, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for number, path, own in paths(text, rates.get(language_of(text), {})):
                    docs.append(doc)
                    sites.append(site)
                    numbers.append(number)
                    names.append(path)
                    values.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(sites, pa.string()), pa.array(numbers, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["doc", "site", "line_no", "path", "own"])

    return run


def _pages(sources: DataFrame) -> DataFrame:
    pages = sources.where(F.col("origin").isNotNull() & F.col("doc_id").isNotNull() & F.col("raw_text").rlike(r"\S"))
    pages = pages.groupBy("doc_id").agg(F.min(F.struct("raw_text", "origin")).alias("p"))
    return pages.select(F.col("doc_id").alias("doc"), F.col("p.origin").alias("site"), F.col("p.raw_text").alias("text"))


def common_pieces(pages: DataFrame) -> dict[str, dict[int, tuple[float, float]]]:
    """By language, how common the pieces on at least ``RARE`` of its pages are (1: their text counts half), and how often lists follow."""
    pieces = pages.mapInArrow(_pieces, "lang string, sort string, piece bigint, signature bigint, listed double, leads double")
    once = pieces.groupBy("lang", "sort", "piece", "signature").agg(F.avg("listed").alias("listed"), F.avg("leads").alias("leads"))
    counted = once.groupBy("lang", "sort", "piece").agg(F.count("*").alias("n"), F.avg("listed").alias("listed"), F.avg("leads").alias("leads"))
    sizes = pages.mapInArrow(_languages, "lang string").groupBy("lang").agg(F.count("*").alias("pages"))
    rate = (F.col("n") - CHANCE) / F.col("pages")
    rows = counted.where(F.col("n") > CHANCE).join(F.broadcast(sizes), "lang").select("lang", "sort", "piece", rate.alias("rate"), "listed", "leads").where(F.col("rate") >= RARE)
    by_language: dict[str, list] = {}
    for row in rows.toLocalIterator():
        by_language.setdefault(row["lang"], []).append(row)
    return {language: _how_common(rows) for language, rows in by_language.items()}


def _how_common(rows: list) -> dict[int, tuple[float, float]]:
    heading = sorted(r["rate"] for r in rows if r["sort"] == "e" and r["leads"] >= 0.45)
    level = max(LEAST_LEVEL, CHANCE_SHARE * heading[int(0.99 * (len(heading) - 1))]) if len(heading) >= 20 else LEAST_LEVEL * 4
    out = {}
    for row in rows:
        if row["sort"] == "e":
            value = row["rate"] * (1 - row["leads"]) ** 2 / level
        elif row["sort"] == "g":
            value = row["rate"] / COMMON["g"] if row["leads"] < 0.08 else 0.0
        else:
            value = row["rate"] / COMMON[row["sort"]]
        if value >= 0.3:
            out[row["piece"]] = (value, row["listed"])
    return out


def _languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([language_of(x) for x in batch.column(2).to_pylist()], pa.string())], ["lang"])


def scored_lines(sources: DataFrame) -> DataFrame:
    """(doc, line_no, path, own, score) of every non-blank line of the pages with an origin."""
    pages = _pages(sources)
    shared = sources.sparkSession.sparkContext.broadcast(common_pieces(pages))
    lines = cut_lineage(pages.mapInArrow(_paths_of(shared), "doc string, site string, line_no int, path string, own double"))
    by_site = lines.groupBy("site", "path").agg(F.sum("own").alias("s"), F.count("*").alias("n"))
    by_path = by_site.groupBy("path").agg((F.sum("s") / F.sum("n")).alias("all_sites"))  # a few dozen paths
    ratios = by_site.join(F.broadcast(by_path), "path").select("site", "path", ((F.col("s") + 20 * F.col("all_sites")) / (F.col("n") + 20)).alias("ratio"))
    parts = ratios.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = lines.withColumn("part", F.pmod(F.hash("doc"), F.lit(SALTS)))
    fused = spread.join(parts, ["site", "path", "part"]).withColumnRenamed("ratio", "fused")
    along = Window.partitionBy("doc").orderBy("line_no").rowsBetween(-1, 1)
    return fused.withColumn("score", 0.8 * F.col("fused") + 0.2 * F.avg("fused").over(along)).select("doc", "line_no", "path", "own", "score")


def find_boilerplate(sources: DataFrame) -> DataFrame:
    """(doc_id, line_no) of the lines that aren't part of the article."""
    return scored_lines(sources).where(F.col("score") < THRESHOLD).select(F.col("doc").alias("doc_id"), "line_no")


def main_bodies(sources: DataFrame) -> DataFrame:
    """(doc_id, text): the article of each page, in its own lines."""
    found = find_boilerplate(sources).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    pages = _pages(sources).select(F.col("doc").alias("doc_id"), F.col("text").alias("raw_text"))
    kept = pages.join(found, "doc_id", "left").withColumn("lines", F.split("raw_text", "\n"))
    text = F.array_join(F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("gone", (i + 1).cast("int")), F.lit(False))), "\n")
    return kept.select("doc_id", F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("text"))
