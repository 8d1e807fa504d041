"""Problem 10: pages that are search bait (repeated keywords, lists of links or trails, tags and product labels), not prose or data.

Method: rank-frequency curves. Each page is cut into segments of up to ``SEGMENT`` words (never across a blank line, so that a page that
opens with prose keeps its prose apart; blocks of under ``LEAST`` words are judged together), words are counted within each (any figure as
one word, the sign of a tag or of a step in a trail as one, a link as one for every ``LINK_SIGNS`` of its signs), and SQL windows over the counts give each segment's curve: its slope, its
residual and its number of ranks. Prose of the same language and a comparable length is described by quantiles on the side bait doesn't
reach (bait is steeper, less even and has fewer ranks): the ``MIDDLE`` quantile, and its distance to the ``FAR`` one as the spread; neither moves
as long as bait is under ``MIDDLE`` of the segments of that kind, and ranks are never expected to be fewer than the growth of ranks with
length, fitted over all segments, says. A segment is bait if its divergences in ranks, slope and residual, in spreads, add up
to ``EXTREME``; nothing else decides. A page is bait if such segments hold more than half of its text.

Counts leave a page as (frequency, number of words with it) pairs, a handful a segment, so what is shuffled is small against the text.
Quantiles come from mergeable sketches; nothing depends on how many pages one source has.

Defined cases: null and blank texts are no cases; texts without any word, figure or link neither; repeated doc_ids count once; other
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage
from docloom.llm.word_lists import FUNCTION_WORDS

SEGMENT = 80
LEAST = 12
LINK_SIGNS = 16
MIDDLE, FAR = 0.6, 0.85
#: Weights of slope and residual beside ranks, and the sum of divergences from which a segment is bait.
WEIGHTS = {"ranks": 1.0, "slope": 0.5, "residual": 0.5}
EXTREME = 8.5
#: Least spreads; that of ranks is more for short segments, where one word more or less is much.
LEAST_SPREADS = {"ranks": 0.04, "slope": 0.04, "residual": 0.015}
ONE_WORD = 0.8
#: Segments from which on a language is compared with its own.
ENOUGH = 30
SHARE = 0.5
_LINK = re.compile(r"(?:https?://|www\.)[^\s)\]>]+", re.I)
_TOKEN = re.compile(r"\x01|#(?=\w)|(?<=\s)[>»›/](?=\s)|\d+(?:[.,]\d+)*|[^\W\d_]+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
_LANGUAGE_OF: dict[str, tuple[str, ...]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words:
        _LANGUAGE_OF[_word] = tuple(dict.fromkeys((*_LANGUAGE_OF.get(_word, ()), _language)))


def segments(text: str) -> list[tuple[int, list[str]]]:
    """(characters, words) of each segment of a page; blocks of under ``LEAST`` words are judged together, wherever they stand."""
    blocks: list[tuple[int, list[str]]] = []
    short, short_size = [], 0
    for block in _BLANK_LINE.split(text):
        body = _LINK.sub(lambda m: " \x01 " * -(-len(m.group()) // LINK_SIGNS), block) if "://" in block or "www." in block else block
        words = ["0" if w[0].isdigit() else ">" if w in "»›/" else w for w in _TOKEN.findall(body.lower())]
        size = sum(map(len, block.split()))
        if len(words) < LEAST:
            short, short_size = short + [words], short_size + size
        elif size:
            blocks.append((size, words))
    if short_size:
        blocks.append((short_size, [w for words in short for w in words]))
    cut: list[tuple[int, list[str]]] = []
    for size, words in blocks:
        pieces = max(1, -(-len(words) // SEGMENT))
        for at in range(pieces):
            part = words[at * len(words) // pieces : (at + 1) * len(words) // pieces]
            cut.append((size * (at + 1) // pieces - size * at // pieces, part))
    return cut


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cut = segments(text)
            counted = [Counter(words) for _, words in cut]
            votes: Counter[str] = Counter()
            for counts in counted:
                for word in counts.keys() & _LANGUAGE_OF.keys():
                    for language in _LANGUAGE_OF[word]:
                        votes[language] += counts[word]
            language = max(sorted(votes), key=lambda x: votes[x]) if votes else "none"
            total = sum(size for size, _ in cut)
            for at, ((size, words), counts) in enumerate(zip(cut, counted, strict=True)):
                if not words:
                    continue
                held = Counter(counts.values())
                for column, value in zip(out, (key, at, language, len(words), size, total, list(held), list(held.values())), strict=True):
                    column.append(value)
        kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc", "seg", "lang", "n", "size", "total", "freq", "types"])


def curves(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment with its rank-frequency curve: the logarithm of its ranks, slope and residual."""
    kept = documents.select(F.col(key).alias("doc"), F.col(text).alias("body")).where(F.col("doc").isNotNull() & F.col("body").rlike(r"\S"))
    kind = kept.schema["doc"].dataType.simpleString()
    counted = kept.mapInArrow(_counts, f"doc {kind}, seg int, lang string, n int, size int, total int, freq array<int>, types array<int>")
    points = counted.select("doc", "seg", "lang", "n", "size", "total", F.explode(F.arrays_zip("freq", "types")).alias("p"))
    points = points.select("doc", "seg", "lang", "n", "size", "total", F.col("p.freq").alias("freq"), F.col("p.types").alias("types"))
    points = points.repartition("doc", "seg").dropDuplicates(["doc", "seg", "freq"])  # repeated pages count once; the windows use the same partitioning
    down = Window.partitionBy("doc", "seg").orderBy(F.desc("freq"))
    ranked = points.withColumn("upto", F.sum("types").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    x = F.ln(F.col("upto") - (F.col("types") - 1) / 2)
    ranked = ranked.withColumns({"x": x, "y": F.ln("freq"), "w": F.col("types").cast("double")})
    own = Window.partitionBy("doc", "seg")
    weight = F.sum("w").over(own)
    ranked = ranked.withColumns({"mx": F.sum(F.col("w") * F.col("x")).over(own) / weight, "my": F.sum(F.col("w") * F.col("y")).over(own) / weight})
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = ranked.groupBy("doc", "seg").agg(*(F.first(c).alias(c) for c in ("lang", "n", "size", "total")), F.sum("types").alias("types"), F.sum(F.col("w") * dx * dx).alias("sxx"), F.sum(F.col("w") * dx * dy).alias("sxy"), F.sum(F.col("w") * dy * dy).alias("syy"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(F.lit(0.0))
    rest = F.when(F.col("sxx") > 0, F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")).otherwise(F.lit(0.0))
    fitted = sums.select("doc", "seg", "lang", "n", "size", "total", F.ln("types").alias("ranks"), slope.alias("slope"), F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("types")).alias("residual"))
    return cut_lineage(fitted.withColumn("length", F.floor(F.log2("n") * 2).cast("int")))


#: Which way each measure of bait departs from prose.
_SIDES = {"ranks": 1, "slope": 1, "residual": -1}


def _prose(mark: str) -> list:
    out = []
    for name, side in _SIDES.items():
        middle, far = (MIDDLE, FAR) if side > 0 else (1 - MIDDLE, 1 - FAR)
        quantiles = F.percentile_approx(name, F.array(F.lit(middle), F.lit(far)), 1000)
        out += [quantiles[0].alias(f"{mark}_{name}"), F.abs(quantiles[1] - quantiles[0]).alias(f"{mark}s_{name}")]
    return out


def judge_segments(fitted: DataFrame) -> DataFrame:
    """Segments with their divergence from prose of the same language and a comparable length: in ranks, slope, residual, and in all."""
    same = fitted.groupBy("lang", "length").agg(*_prose("m"), F.count("*").alias("seen"))
    every = fitted.groupBy("length").agg(*_prose("a"), F.avg(F.ln("n")).alias("at_n"), F.count("*").alias("any"))
    growth = every.where(F.col("any") >= ENOUGH).agg(F.coalesce(F.least(F.greatest(F.expr("regr_slope(a_ranks, at_n)"), F.lit(0.5)), F.lit(1.0)), F.lit(1.0)).alias("growth"))
    # lengths few segments have are judged by the nearest length that many have; both tables have a row for each length
    solid = every.where(F.col("any") >= ENOUGH).withColumnRenamed("length", "near_length")
    stats = [c for c in every.columns if c not in ("length", "any")]
    lent = every.select("length").crossJoin(solid).groupBy("length").agg(F.min_by(F.struct(*stats), F.struct(F.abs(F.col("near_length") - F.col("length")), "near_length")).alias("lent"))
    every = every.join(lent, "length", "left").select("length", *(F.coalesce(F.col(f"lent.{c}"), F.col(c)).alias(c) for c in stats))
    level = fitted.crossJoin(F.broadcast(growth)).groupBy("growth").agg(F.percentile_approx(F.col("ranks") - F.col("growth") * F.ln("n"), MIDDLE, 1000).alias("level"))  # one row beside each
    near = fitted.join(F.broadcast(same), ["lang", "length"], "left").join(F.broadcast(every), "length").crossJoin(F.broadcast(level))  # a few rows for each language
    own = (F.col("seen") >= ENOUGH) & (F.col("lang") != "none")
    out, total = {}, F.lit(0.0)
    for name, side in _SIDES.items():
        general = F.col(f"a_{name}") + (F.col("growth") * (F.ln("n") - F.col("at_n")) if name == "ranks" else 0.0)
        at = F.when(own, F.col(f"m_{name}")).otherwise(general)
        spread = F.when(own, F.col(f"ms_{name}")).otherwise(F.col(f"as_{name}"))
        spread = F.greatest(spread, F.lit(LEAST_SPREADS[name]))
        if name == "ranks":
            at = F.greatest(at, F.col("level") + F.col("growth") * F.ln("n") - 0.2)
            spread = F.greatest(spread, F.lit(ONE_WORD) / F.col("n"))
        out[f"by_{name}"] = F.greatest((at - F.col(name)) * side / spread, F.lit(-3.0))
        total = total + WEIGHTS[name] * F.col(f"by_{name}")
    return near.withColumns(out).withColumn("divergence", total).select("doc", "seg", "lang", "n", "size", "total", *out, "divergence")


def is_bait():
    """The flag over the columns of ``judge_segments``."""
    return F.col("divergence") > EXTREME


def find_bait(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` of every page more than half of which is bait."""
    judged = judge_segments(curves(documents, key, text))
    pages = judged.groupBy("doc").agg(F.sum(F.when(is_bait(), F.col("size")).otherwise(0)).alias("bait"), F.max("total").alias("total"))
    return pages.where(F.col("bait") > SHARE * F.col("total")).select(F.col("doc").alias(key))
