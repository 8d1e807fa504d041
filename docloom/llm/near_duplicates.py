"""Problem 1: records that differ by small edits, in text or in file name.

Method: meet-in-the-middle ball hashing. Every fingerprint emits all variants within half the radius, variants are shuffled, and records
that meet in a variant are deduplicated and verified exactly.

* Texts. The set of ``WORDS``-word runs of a text gives ``PRINTS`` fingerprints of ``SYMBOLS`` min-hashes each. The distance of two
  fingerprints counts symbols to delete and insert; the radius is ``2 * ERASED``, so each side emits every choice of ``ERASED`` deleted
  symbols (its ball of half the radius) and two texts meet exactly when a fingerprint lies within the radius. At a similarity of 0.6 one
  fingerprint meets with probability 0.68, one of seven with 0.9997 (0.99996 at 0.65). Pairs that meet are verified by the exact
  similarity of their sets.
* File names. The canonical name is the fingerprint, the radius two letters (delete and insert): each side emits the name with each one
  letter deleted, which any two names a single mistyped letter apart have in common. Digits are never deleted.

Texts with the same set of runs (and names with the same canonical form) form one class; only classes are compared, by 64-bit numbers that
are looked up again before verification, so that two classes with one number cost a comparison and lose nothing. Only variants travel at
first: no text and no set. A variant with many classes is cut into blocks of ``HOT`` classes, and blocks are joined with blocks, so no task
gathers a whole hot variant. The texts of classes that meet are then fetched, once each, and each pair's sets compared.

Groups (``text_groups``) don't need all pairs: in each variant every class is compared with the least one, and only those that turn out
unlike it with all others of the variant. A group of n near-copies costs n comparisons, and no link between groups is lost.

Defined cases: null and blank texts or names are no cases; texts of under ``WORDS`` words have no runs and match nothing; rows of one
document count once (of several texts the one whose set has the least hash); a pair is one row with the smaller id (as a string) first;
equal ids never pair; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

WORDS = 3
SIMILARITY = 0.6
PRINTS = 7
SYMBOLS = 5
ERASED = 2
HOT = 500
#: Rows of a key and a few bytes that may be broadcast.
FEW = 250_000
SEED = 20_240_501
MEMO_ENTRIES = 300_000
_WORD = re.compile(r"\w+").findall

#: Marks that file managers and people put on another copy of the same document.
_MARK_WORDS = frozenset("copy copie kopie copia copies final finale endfassung definitivo definitif draft entwurf brouillon borrador neu new nouveau nuevo old alt ancien viejo updated corrected signed scan scanned latest".split())
_LINK_WORDS = frozenset("of von de del du da".split())
_EXTENSION = re.compile(r"\.(?:pdf|txt|html?|docx?|csv|md|markdown|json|rst|log|py|rtf|odt|xlsx?|pptx?|xml|tiff?|jpe?g|png|zip)$")
_COUNTED = re.compile(r"\(\s*\d{1,3}\s*\)|\[\s*\d{1,3}\s*\]|~\d{1,3}(?=$|[^0-9a-z])")
_VERSION = re.compile(r"(?<![^\W_])(?:v|ver|version|rev|revision|r)[\s._-]?\d{1,3}(?:[._]\d{1,3}){0,2}(?![^\W_])")
_PIECES = re.compile(r"[^\W_]+")


def canonical_name(name: str | None) -> str | None:
    """A file name without letter case, separators, percent-encoding, extension and marks of a copy, draft, final or numbered version."""
    if not name or not name.strip():
        return None
    text = unicodedata.normalize("NFKC", unquote(name)).strip().lower().replace("\\", "/").rsplit("/", 1)[-1]
    while (cut := _EXTENSION.sub("", text).rstrip()) != text and cut:
        text = cut
    plain = _VERSION.sub(" ", _COUNTED.sub(" ", text))
    words = _PIECES.findall(plain)
    kept: list[str] = []
    marked = False
    for word in words:
        if word in _MARK_WORDS or (marked and word in _LINK_WORDS):
            marked = True
            continue
        marked = False
        kept.append(word)
    return "".join(kept or _PIECES.findall(text)) or None


def one_letter_apart(a: str, b: str) -> bool:
    """Whether two different names differ by one letter typed wrong, left out, added or swapped with its neighbour."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    head = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    if len(a) < len(b):
        return a[head:] == b[head + 1 :] and b[head].isalpha()
    if a[head + 1 :] == b[head + 1 :]:
        return a[head].isalpha() and b[head].isalpha()
    return a[head + 2 :] == b[head + 2 :] and a[head : head + 2] == b[head : head + 2][::-1] and a[head : head + 2].isalpha()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RunHasher:
    """The set of hashed word runs of a text."""

    def __init__(self, words: int):
        self.words = words
        self.memo: dict[str, int] = {}
        self.turns = np.random.default_rng(SEED).integers(1, 1 << 62, size=words, dtype=np.uint64) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        memo, ids = self.memo, []
        for word in _WORD(text):
            value = memo.get(word)
            if value is None:
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                value = memo[word] = xxhash.xxh64_intdigest(word.lower())
            ids.append(value)
        coded = np.array(ids, dtype=np.uint64)
        if len(coded) < self.words:
            return np.zeros(0, dtype=np.uint64)
        total = np.zeros(len(coded) - self.words + 1, dtype=np.uint64)
        for at, turn in enumerate(self.turns):
            total += _mix(coded[at : len(coded) - self.words + 1 + at] * turn + np.uint64(at))
        return np.unique(_mix(total))


def _minima(values: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    symbols = np.full(PRINTS * SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for first in range(0, len(values), 4096):
        symbols = np.minimum(symbols, _mix(values[first : first + 4096, None] * times + plus).min(axis=0))
    return symbols


def _hashed(words: int):
    """(id, class, number of the class, variants) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = RunHasher(words)
        drawn = np.random.default_rng(SEED + 1)
        times = drawn.integers(1, 1 << 62, size=PRINTS * SYMBOLS, dtype=np.uint64) | np.uint64(1)
        plus = drawn.integers(1, 1 << 62, size=PRINTS * SYMBOLS, dtype=np.uint64)
        kept = np.array(list(itertools.combinations(range(SYMBOLS), SYMBOLS - ERASED)))
        places = (np.arange(PRINTS)[:, None, None] * SYMBOLS + kept[None]).reshape(-1, SYMBOLS - ERASED)
        for batch in batches:
            names, classes, numbers, variants = [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs = hasher(text)
                if not len(runs):
                    continue
                symbols = _minima(runs, times, plus)
                total = np.zeros(len(places), dtype=np.uint64)
                for at in range(places.shape[1]):
                    total = _mix(total + symbols[places[:, at]] + places[:, at].astype(np.uint64))
                digest = xxhash.xxh3_128_digest(runs.tobytes())
                names.append(name)
                classes.append(digest)
                numbers.append(int.from_bytes(digest[:8], "little", signed=True))
                variants.append(total.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(classes, pa.binary()), pa.array(numbers, pa.int64()), pa.array(variants, pa.list_(pa.int64()))], ["id", "cls", "number", "variants"])

    return run


def _sets(words: int):
    """(class, number, set of runs) of the wanted texts; other texts of the same document are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = RunHasher(words)
        for batch in batches:
            keep, sets = [], []
            for at, (cls, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                runs = hasher(text)
                if xxhash.xxh3_128_digest(runs.tobytes()) == cls:
                    keep.append(at)
                    sets.append(runs.view(np.int64))
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(sets, pa.list_(pa.int64()))], ["cls", "number", "runs"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact similarity of pairs of sets; both come sorted."""
    for batch in batches:
        values = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.asarray(left.values), np.asarray(right.values)
            both = len(np.intersect1d(a, b, assume_unique=True))
            values.append(both / (len(a) + len(b) - both))
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in zip(a, b, strict=True)], pa.binary()), pa.array([max(x) for x in zip(a, b, strict=True)], pa.binary()), pa.array(values, pa.float64()), batch.column(4), batch.column(5)], ["a", "b", "similarity", "met_a", "met_b"])


def _name_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [canonical_name(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array([x and _number(x) for x in names], pa.int64())], ["id", "cls", "number"])


def _name_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        numbers, variants = [], []
        for name in batch.column(0).to_pylist():
            ball = {name} | {name[:i] + name[i + 1 :] for i, letter in enumerate(name) if letter.isalpha()}
            numbers += [_number(name)] * len(ball)
            variants += [xxhash.xxh64_intdigest(v) - (1 << 63) for v in ball]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(variants, pa.int64())], ["number", "variant"])


def _number(name: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(name, seed=1) - (1 << 63)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([one_letter_apart(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.bool_()))


def meetings(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Pairs (a, b), a < b, of values of ``name`` that share a ``key``; hot keys are cut into blocks that are joined with blocks.

    ``rows`` must be distinct. One aggregate gives the pair of every key that two values share; only keys of more go on, by a broadcast
    where they are at most ``FEW`` and by a shuffle beyond. Every block pair is one join key, so the work on a hot key spreads over all
    tasks; a plain equi-join does the rest.
    """
    shared = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("n"), F.min(name).alias("a"), F.max(name).alias("b")).where("n > 1"))
    pairs = shared.where("n = 2").select("a", "b")
    hot = shared.where("n > 2").select(key, F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))
    many = hot.count()
    if not many:
        return pairs
    some = cut_lineage(rows.select(key, name).join(F.broadcast(hot) if many <= FEW else hot, key))  # both sides read these rows
    left = some.select(F.col(key), F.pmod(F.hash(F.col(name), F.lit(7)), F.col("blocks")).alias("block"), F.col(name).alias("a"))
    right = some.select(F.col(key), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col(name).alias("b"))
    return pairs.unionByName(left.join(right, [key, "block"]).where("a < b").select("a", "b"))


class Texts:
    """The texts of a collection as classes with their variants. ``texts``: id STRING, text STRING."""

    def __init__(self, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY):
        self.rows = texts.select("id", "text").where(F.col("id").isNotNull() & F.col("text").rlike(r"\S"))
        self.words, self.similarity = words, similarity
        hashed = cut_lineage(self.rows.mapInArrow(_hashed(words), "id string, cls binary, number bigint, variants array<bigint>"))
        self.members = hashed.groupBy("id").agg(F.min("cls").alias("cls"))
        classes = hashed.groupBy("cls").agg(F.min("id").alias("id"), F.first("number").alias("number"), F.first("variants").alias("variants"))
        self.variants = classes.select("number", F.explode("variants").alias("variant"))
        self.firsts = hashed.groupBy("cls", "number").agg(F.min("id").alias("id"))

    def verified(self, met: DataFrame) -> DataFrame:
        """(a, b, similarity, met_a, met_b): the similar classes among pairs (a, b) of class numbers."""
        wanted = met.select(F.col("a").alias("number")).unionByName(met.select(F.col("b").alias("number"))).distinct()
        firsts = cut_lineage(self.firsts.join(wanted, "number", "left_semi"))
        asked = self.rows.join(F.broadcast(firsts) if firsts.count() <= FEW else firsts, "id").select("cls", "number", "text").mapInArrow(_sets(self.words), "cls binary, number bigint, runs array<bigint>")
        sets = asked.groupBy("cls", "number").agg(F.first("runs").alias("runs"))
        first = met.join(sets.select(F.col("number").alias("a"), F.col("cls").alias("cls_a"), F.col("runs").alias("runs_a")), "a")
        both = first.join(sets.select(F.col("number").alias("b"), F.col("cls").alias("cls_b"), F.col("runs").alias("runs_b")), "b")
        scored = both.select("cls_a", "cls_b", "runs_a", "runs_b", "a", "b").mapInArrow(_compared, "a binary, b binary, similarity double, met_a bigint, met_b bigint")
        return scored.where(F.col("similarity") >= self.similarity)


def text_pairs(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, cls) of each text, and (a, b, similarity) of the similar classes. ``texts``: id STRING, text STRING."""
    made = Texts(texts, words, similarity)
    met = cut_lineage(meetings(made.variants, "variant", "number").distinct())
    return made.members, made.verified(met)


def text_groups(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, group_id): the connected group of each text, named by its smallest id, without all pairs of a hot variant."""
    made = Texts(texts, words, similarity)
    least = made.variants.groupBy("variant").agg(F.min("number").alias("a"), F.count("*").alias("n")).where("n > 1").select("variant", "a")
    held = cut_lineage(made.variants.join(least, "variant").where("number <> a").select("variant", "a", F.col("number").alias("b")))
    stars = cut_lineage(made.verified(held.select("a", "b").distinct()))
    like = stars.select(F.col("met_a").alias("a"), F.col("met_b").alias("b")).distinct()
    rest = held.join(like, ["a", "b"], "left_anti").select("variant", F.col("b").alias("x"))
    others = rest.join(held.select("variant", "b"), "variant").where("x <> b")
    again = others.select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()
    return classes(made.members, stars.select("a", "b").unionByName(made.verified(again).select("a", "b")))


def name_pairs(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, cls) of each name, and (a, b) of the classes one letter apart. ``names``: id STRING, name STRING."""
    rows = names.where("id is not null and name is not null")
    members = cut_lineage(rows.select("id", "name").mapInArrow(_name_classes, "id string, cls string, number bigint").where("cls is not null").distinct())
    held = members.select("cls", "number").distinct()
    variants = held.select("cls").mapInArrow(_name_variants, "number bigint, variant bigint")
    met = meetings(variants, "variant", "number").distinct()
    named = met.join(held.select(F.col("number").alias("a"), F.col("cls").alias("x")), "a").join(held.select(F.col("number").alias("b"), F.col("cls").alias("y")), "b")
    pairs = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).mapInArrow(_apart, "a string, b string")
    return members.select("id", "cls"), pairs


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of all records in the same or in similar classes."""
    inside = meetings(members, "cls", "id")
    left = pairs.select("a", "b").join(members.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a")
    across = left.join(members.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b")
    across = across.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return inside.unionByName(across).distinct().select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def find_pairs(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (field_name, doc_id_a, doc_id_b) over the source texts and the registry's file names."""
    texts = record_pairs(*text_pairs(sources.select(F.col("doc_id").alias("id"), F.col("raw_text").alias("text"))))
    names = record_pairs(*name_pairs(registry.select(F.col("doc_id").alias("id"), F.col("filename").alias("name"))))
    return texts.select(F.lit("raw_text").alias("field_name"), "*").unionByName(names.select(F.lit("filename").alias("field_name"), "*"))


def classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id): the connected group of each record, named by its smallest id.

    Links between classes are turned into stars: each round every class links its larger neighbours, then its smaller ones and itself, to its least
    neighbour, until no link changes; rounds grow with the logarithm of the longest chain. Every round is written to the checkpoint folder.
    Only links between classes take part, however many copies a class has.
    """
    edges = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    placed = members.join(roots.withColumnRenamed("u", "cls"), "cls", "left").select("id", F.coalesce("root", "cls").alias("root"), "cls")
    named = placed.groupBy("root").agg(F.min("id").alias("group_id"))
    return placed.join(named, "root").select("id", "group_id")
